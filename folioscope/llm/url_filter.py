"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Only DataFrame functions are used. The Bloom filter is a table of at most `blocks` rows of one
64-bit word each (the proven bound of what is broadcast: 16 bytes a block), however long the
list is. A fuller filter lets more URLs through to the exact join, which alone decides.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 18
BITS = 4


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; null if there is none."""
    start = F.instr(url, "://")
    return F.when(start > 0, F.substr(url, start + 3))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """Host as written (port and user included), A-Z lower-cased; empty without `://`."""
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """Path up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without `www.` or `m.` and path without closing slashes: one form per page.

    Null for an empty host, which names no page.
    """
    plain = F.regexp_replace(host, "^(www|m)\\.", "")
    return F.when(host != "", F.concat(plain, F.regexp_replace(path, "/+$", "")))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> list[Column]:
    """(rule, verdict) of the longest fitting rule, or nulls; rules are (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return [rule, verdict]


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bits_of(key: Column) -> Column:
    """The key's bits inside its block: a 64-bit word with up to `BITS` ones."""
    other = F.xxhash64(key, F.lit("bits"))
    word = F.lit(0).cast("long")
    for k in range(BITS):
        at = F.shiftrightunsigned(other, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return word


def bloom_filter(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(block, word) of the column `canonical`: one row per block in use, at most `blocks`."""
    return listed.groupBy(block_of(F.col("canonical"), blocks).alias("block")).agg(
        F.bit_or(bits_of(F.col("canonical"))).alias("word")
    )


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    blocks: int = BLOCKS,
) -> DataFrame:
    """(page_id, host, path, rule, listed, verdict) per row of `pages`.

    A URL with a fitting rule gets that rule's verdict. Any other is blocked if its
    canonical form is that of a URL in `listed`, else allowed. Nulls and URLs without
    `://` have an empty host and path, fit no rule and are allowed. Ids may repeat or be
    null: every row gets its own verdict. An empty list or table is no special case, and
    further columns of either table are ignored.

    A host, URL or key may hold any share of the rows: the list is reduced to distinct
    canonical URLs before it meets the pages, and only URLs that pass the Bloom filter are
    shuffled at all.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    names = (
        listed.select(F.col(listed_col).alias("url"))
        .select(canonical_url(host, path).alias("canonical"))
        .where(F.col("canonical").isNotNull())
        .distinct()
    )
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host.alias("host"), path.alias("path")
    )
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": rule, "verdict": verdict}).withColumn(
        "canonical", F.when(rule.isNull(), canonical_url(F.col("host"), F.col("path")))
    )
    bloom = F.broadcast(bloom_filter(names, blocks))
    probed = (
        judged.withColumn("block", block_of(F.col("canonical"), blocks))
        .join(bloom, "block", "left")
        .withColumn(
            "possible",
            F.col("canonical").isNotNull()
            & F.coalesce(
                F.col("word").bitwiseAND(bits_of(F.col("canonical")))
                == bits_of(F.col("canonical")),
                F.lit(False),
            ),
        )
    )
    columns = ("page_id", "host", "path", "rule", "verdict", "canonical")
    exact = (
        probed.where("possible")
        .select(*columns)
        .join(names.withColumn("listed", F.lit(True)), "canonical", "left")
    )
    return (
        exact.unionByName(
            probed.where(~F.col("possible")).select(*columns, F.lit(None).cast("boolean").alias("listed"))
        )
        .withColumn("listed", F.coalesce("listed", F.lit(False)))
        .withColumn(
            "verdict",
            F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")),
        )
        .select("page_id", "host", "path", "rule", "listed", "verdict")
    )
