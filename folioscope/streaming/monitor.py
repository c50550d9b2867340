"""Streaming admission and status counts; both also accept a static DataFrame."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.urls import normalize_url, url_error


def admit_stream(captures: DataFrame, horizon: str = "1 day", time: str = "ts") -> DataFrame:
    """First capture per normalized URL within the horizon; for others see rejected_urls().

    In a stream each URL is one small state entry that expires with the watermark, and the
    first one to arrive counts. In a table it is the earliest one by time, then by value.
    """
    valid = captures.withColumn("normalized_url", normalize_url(F.col("url"))).where(
        F.col("normalized_url").isNotNull()
    )
    if not captures.isStreaming:
        rest = [c for c in captures.columns if c != time]
        earliest = valid.groupBy("normalized_url").agg(F.min(F.struct(time, *rest)).alias("_row"))
        return earliest.select(*[F.col("_row")[c].alias(c) for c in captures.columns], "normalized_url")
    return valid.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["normalized_url"])


def rejected_urls(captures: DataFrame) -> DataFrame:
    """Captures whose URL cannot be admitted, with the error code."""
    return captures.withColumn("error_code", url_error(F.col("url"))).where(
        F.col("error_code").isNotNull()
    )


def status_windows(
    events: DataFrame, size: str = "1 hour", status: str = "status", lateness: str = "10 minutes"
) -> DataFrame:
    """Rows per tumbling window and status: (window_start, status, n)."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    return (
        timed.groupBy(F.window("ts", size), F.col(status).alias("status"))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "status", "n")
    )


def status_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Bursts of activity per key: (key, session_start, session_end, n).

    An event belongs to a burst if it comes less than `gap` after the one before. In a table a
    key may own any share of the events: they are first counted per span of `gap`, whose events
    all belong together, and only these counts, at most one a span, are put in order.
    """
    if events.isStreaming:
        window = F.session_window("ts", gap)
        counted = events.withWatermark("ts", lateness).groupBy(window, "key").agg(F.count("*").alias("n"))
        start, end = F.col("session_window.start"), F.col("session_window.end")
        return counted.select("key", start.alias("session_start"), end.alias("session_end"), "n")
    length = F.expr(f"INTERVAL {gap}")
    spans = events.groupBy("key", F.window("ts", gap)["start"].alias("span")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")
    )
    order = W.partitionBy("key").orderBy("span")
    begins = ~F.coalesce(F.col("first") < F.lag("last").over(order) + length, F.lit(False))
    numbered = spans.withColumn("session", F.sum(begins.cast("int")).over(order))
    return numbered.groupBy("key", "session").agg(
        F.min("first").alias("session_start"),
        (F.max("last") + length).alias("session_end"),
        F.sum("n").alias("n"),
    ).drop("session")
