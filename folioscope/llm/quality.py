"""Quality rules with host verdicts: rule failures per host, shrunk by an empirical beta prior.

Only DataFrame functions are used. Everything about one text is computed in its own row
(nothing but a few numbers per document is shuffled); hosts are counted with map-side
partial sums, so one host may own any share of the documents.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import BLANKS, cut, words


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    A document fails below `min_words` words or when more than `max_repeat_percent` of its
    words lie in windows of `window` words that occur twice or more in it. A host fails
    when its shrunk failure rate exceeds `max_host_rate`.
    """

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    max_host_rate: float = 0.5
    symbols: str = "#*$%&|<>"


def covered(starts: Column, width: int) -> Column:
    """Number of positions covered by windows of `width` at ascending `starts`."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + s + width - F.greatest(s, a["end"])).alias("n"), (s + width).alias("end")
        ),
        lambda a: a["n"],
    )


def text_features(docs: DataFrame, rules: Rules, id_col: str, text_col: str, host_col: str):
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words).

    Windows are compared by a 64-bit hash of their words' hashes, within one document.
    Equal hashes meet by sorting, and only in documents that repeat a window at all.
    """
    width = rules.window
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        words(F.col(text_col)).alias("words"),
        lines.alias("lines"),
        F.length(F.regexp_replace(text, f"[^{rules.symbols}]+", "")).alias("n_symbols"),
    )
    # Several uses of `hashes` keep it a column of its own, computed outside the loop below.
    split = split.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    hashed = split.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("hashes") >= width,
            F.transform(
                F.sequence(F.lit(1), F.size("hashes") - (width - 1)),
                lambda i: F.xxhash64(F.slice("hashes", i, width)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    none = F.array().cast("array<struct<hash:bigint,at:bigint>>")
    placed = hashed.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(
                F.transform(
                    "windows",
                    lambda h, i: F.struct(h.alias("hash"), i.cast("long").alias("at")),
                )
            ),
        ).otherwise(none),
    ).drop("windows")
    repeated = placed.withColumn(
        "starts",
        F.sort_array(
            F.transform(
                F.filter(
                    "placed",
                    lambda p, k: F.coalesce(
                        p["hash"] == F.get("placed", k - 1)["hash"], F.lit(False)
                    )
                    | F.coalesce(p["hash"] == F.get("placed", k + 1)["hash"], F.lit(False)),
                ),
                lambda p: p["at"],
            )
        ),
    ).drop("placed")
    return repeated.withColumn("n_repeat_words", covered(F.col("starts"), width)).drop("starts")


def host_verdicts(features: DataFrame, rules: Rules) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_failed) of `features` with `base_failed`.

    The beta prior has the pooled failure rate as its mean; its strength follows from how
    much more the hosts differ than chance explains (moments of the beta-binomial law).
    Documents without a host belong to none.
    """
    hosts = (
        features.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(
            F.count("*").cast("double").alias("n"),
            F.sum(F.col("base_failed").cast("double")).alias("f"),
        )
    )
    sums = hosts.agg(
        F.sum("n").alias("n"),
        F.sum("f").alias("f"),
        F.count("*").alias("hosts"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff"),
    )
    mean = F.col("f") / F.col("n")
    spread = mean * (1 - mean)
    free = F.col("hosts") - 1
    excess = (F.col("ff") - mean * F.col("f") - spread * free) / F.nullif(
        spread * (F.col("n") - F.col("nn") / F.col("n") - free), F.lit(0.0)
    )
    # The share of variance between hosts, kept inside (0, 1): a strength of 1 to 10,000.
    share = F.least(F.greatest(F.coalesce(excess, F.lit(0.0)), F.lit(1e-4)), F.lit(0.5))
    prior = sums.select(
        (mean * (1 / share - 1)).alias("failed"), (1 / share - 1).alias("strength")
    )
    failed, strength = prior.select("failed").scalar(), prior.select("strength").scalar()
    rate = (F.col("f") + failed) / (F.col("n") + strength)
    return hosts.select(
        "host",
        F.col("n").cast("long").alias("n_docs"),
        F.col("f").cast("long").alias("n_failed"),
        rate.alias("shrunk_rate"),
    ).withColumn("host_failed", F.col("shrunk_rate") > rules.max_host_rate)


def judge(
    docs: DataFrame,
    rules: Rules = Rules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """One row per document: its counts, `base_failed`, its host's figures and `kept`.

    A document is kept if it passes its own rules and its host passes. A null text has no
    words and fails; a null host gives no host verdict, so the document's own rules decide;
    a null id is carried through. Repeated rows are judged and counted one by one, an empty
    table gives an empty result and other columns are ignored.
    """
    features = text_features(docs, rules, id_col, text_col, host_col)
    few = F.col("n_words") < rules.min_words
    repeats = 100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    features = cut(features.withColumn("base_failed", few | repeats))
    hosts = host_verdicts(features, rules)
    return (
        features.join(hosts, "host", "left")
        .withColumn(
            "kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))
        )
    )
