"""Page captures: reading, decoding raw bytes, and the streaming source."""

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from folioscope import constants as K
from folioscope.schema import CAPTURES

# Encoding labels of the web whose meaning differs from Python's codec of that name.
WEB_LABELS = {
    "gbk": "gb18030",
    "gb2312": "gb18030",
    "gb_2312-80": "gb18030",
    "x-gbk": "gb18030",
    "utf8": "utf-8",
    "unicode-1-1-utf-8": "utf-8",
    "utf-16": "utf-16-le",
    "utf-16le": "utf-16-le",
    "utf-16be": "utf-16-be",
    "ascii": "cp1252",
    "us-ascii": "cp1252",
    "latin1": "cp1252",
    "l1": "cp1252",
    "iso-8859-1": "cp1252",
    "iso8859-1": "cp1252",
    "iso-8859-9": "cp1254",
    "latin5": "cp1254",
    "iso-8859-11": "cp874",
    "tis-620": "cp874",
    "shift_jis": "cp932",
    "shift-jis": "cp932",
    "sjis": "cp932",
    "x-sjis": "cp932",
    "euc-kr": "cp949",
    "ks_c_5601-1987": "cp949",
    "korean": "cp949",
    "big5": "big5hkscs",
    "x-big5": "big5hkscs",
    "macintosh": "mac_roman",
    "x-mac-cyrillic": "mac_cyrillic",
}
# Codecs a page may name; anything else is an unknown label.
WEB_CODECS = frozenset(
    "utf-8 utf-16-le utf-16-be gb18030 big5hkscs euc_jp iso2022_jp cp932 cp949 ibm866 cp866 "
    "koi8-r koi8-u mac-roman mac-cyrillic cp874 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 "
    "cp1256 cp1257 cp1258 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 "
    "iso8859-8 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16".split()
)
_QUOTED = r"""(?:"([^"]+)"|'([^']+)'|([^;\s]+))"""
_META_QUOTED = r"""(?:"([^"]+)"|'([^']+)'|([^\s"'/>;]+))"""


def read_captures(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Captures with a fixed schema; columns that are missing take their defaults."""
    raw = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    return with_capture_defaults(raw)


def with_capture_defaults(raw: DataFrame) -> DataFrame:
    defaults = {
        "final_url": F.col("url"),
        "status_code": F.lit(200),
        "content_type": F.lit("text/html"),
    }
    return raw.select(
        *[
            (F.col(f.name) if f.name in raw.columns else defaults.get(f.name, F.lit(None)))
            .cast(f.dataType)
            .alias(f.name)
            for f in CAPTURES
        ]
    )


def read_capture_stream(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """Streaming source over a folder of Parquet files."""
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(path)


def _label(text: Column, pattern: str) -> Column:
    found = F.concat(*[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)])
    cleaned = F.regexp_replace(F.trim(F.lower(found)), r"""^["']|["']$""", "")
    return F.nullif(cleaned, F.lit(""))


def charset_candidates(
    body: Column, content_type: Column, head_bytes: int = K.CHARSET_HEAD_BYTES
) -> Column:
    """Comma-separated labels in the order to try: byte-order mark, header, <meta>, utf-8.

    A <meta> counts if it stands within the first `head_bytes`.
    """
    start = F.hex(F.substring(body, 1, 3))
    bom = (
        F.when(start == "EFBBBF", "utf-8")
        .when(start.startswith("FFFE"), "utf-16le")
        .when(start.startswith("FEFF"), "utf-16be")
    )
    header = _label(content_type, rf"(?i)(?:^|;)\s*charset\s*=\s*{_QUOTED}")
    prefix = F.decode(F.substring(body, 1, head_bytes), "ISO-8859-1")
    meta = _label(prefix, rf"(?i)<meta\b[^>]*\bcharset\s*=\s*{_META_QUOTED}")
    return F.concat_ws(",", bom, header, meta, F.lit("utf-8"))


def _codec(label: str) -> str | None:
    try:
        name = codecs.lookup(WEB_LABELS.get(label, label)).name
    except LookupError:
        return None
    return name if name in WEB_CODECS else None


@F.pandas_udf(StringType())
def _decode(bodies: pd.Series, labels: pd.Series) -> pd.Series:
    chosen = {
        text: next(c for c in map(_codec, text.split(",")) if c) for text in labels.dropna().unique()
    }

    def decode(body, text):
        if body is None or text is None:
            return None
        return bytes(body).decode(chosen[text], errors="replace").removeprefix(chr(0xFEFF))

    return pd.Series([decode(b, t) for b, t in zip(bodies, labels)], dtype=object)


def decode_captures(df: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """Add `html`, the text of the raw bytes. Labels are found in the JVM, bytes in Python."""
    labelled = df.withColumn(
        "_labels", charset_candidates(F.col(body), F.coalesce(F.col(content_type), F.lit("")))
    )
    return labelled.withColumn("html", _decode(F.col(body), F.col("_labels"))).drop("_labels")
