"""Dedup of lines across documents, with DataFrame functions only.

Normalised lines are exploded and hashed, the distinct documents of each hash are counted, and
lines over the threshold are dropped; what is left is put together by position. Only hashes
and positions are shuffled for the decisions, and each text once, to meet its dropped lines.
"""

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import BLANKS, cut


@dataclass(frozen=True)
class LineRules:
    """Lines of `min_chars` code points or more go if `min_documents` documents hold them."""

    min_chars: int = 20
    min_documents: int = 3


def line_key(line: Column) -> Column:
    """A line without outer blanks, A-Z lower-cased; `lower` is used where it does just that."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(
        F.translate(bare, ascii_uppercase, ascii_lowercase)
    )


def hashed_lines(rows: DataFrame, rules: LineRules) -> DataFrame:
    """(doc_id, version, pos, low, high): the lines that are long enough, by 128 bits of hash."""
    lines = rows.select(
        "doc_id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    keys = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= rules.min_chars).select(
        "doc_id",
        "version",
        "pos",
        F.xxhash64("key").alias("low"),
        F.xxhash64(F.lit("line"), "key").alias("high"),
    )


def common_lines(lines: DataFrame, rules: LineRules) -> DataFrame:
    """(low, high, n_documents, keeper): the lines over the threshold and who keeps them.

    Documents are made distinct by (line, document) first, which spreads a line that most
    documents have; only its partial counts meet.
    """
    return (
        lines.groupBy("low", "high")
        .agg(
            F.count_distinct("doc_id").alias("n_documents"),
            F.max("doc_id").alias("keeper"),
        )
        .where(F.col("n_documents") >= rules.min_documents)
    )


def drop_common_lines(
    docs: DataFrame,
    rules: LineRules = LineRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) per row of `docs`, the text without common lines.

    Lines are cut at line feeds and compared without outer blanks and with A-Z lower-cased.
    A line of `min_chars` or more that `min_documents` or more documents hold goes from all but
    the one with the largest id, which keeps it as often as it has it. The lines left are
    joined by line feeds; a text that loses all of them is empty.

    A null or empty text is one empty line. Rows with one id are one document, whatever their
    texts; rows without an id make no line common and keep none that is. An empty table gives
    no rows and other columns are ignored. A text of any length is one row throughout.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows of equal id and text have equal answers, so the pair stands for the row.
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version")
    )
    lines = cut(hashed_lines(rows, rules))
    # Written, so that the join deals the lines out anew and can split a line that many have.
    common = cut(common_lines(lines, rules).select("low", "high", "keeper"))
    dropped = (
        lines.join(common, ["low", "high"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "version")
        .agg(F.collect_set("pos").alias("dropped"))
        .select(F.col("doc_id").alias("id"), F.col("version").alias("of"), "dropped")
    )
    met = rows.join(
        dropped, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("of")), "left"
    )
    parts = F.split("text", "\n", -1)
    split = met.withColumn("lines", parts)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return split.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )
