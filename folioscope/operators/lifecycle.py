"""Current state of bookmarks from a log of create, delete and restore events.

A delete starts the undo window; a restore inside it brings the bookmark back, a later one
is refused because the bookmark is purged; a create always gives a live bookmark.

One bookmark may own a large share of the log, so its events are never gathered in one
task: the events of a key are folded per span of time into what they do to any state they
may meet, and those small effects, at most one a span, are combined.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K

# Fields of an effect: final state (and time of the delete) when it meets a live or a missing
# bookmark; for a deleted one it depends on `first`, the kind and time of the first event that
# is no delete, and on the state that follows from there.
EFFECT = ("live", "none", "first", "back")


def lifecycle_events(events: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(key, kind, ts, event_id) from raw events; kinds outside the mapping are ignored."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return events.select(
        F.col("user_id").cast("string").alias("key"),
        F.try_element_at(table, F.col("event_type")).alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    ).where(F.col("kind").isNotNull())


def _state(state: str | None) -> Column:
    return F.struct(
        F.lit(state).cast("string").alias("state"), F.lit(None).cast("timestamp").alias("at")
    )


def _after(s: Column, e: Column, span: Column) -> Column:
    """State after one event."""
    create = e["kind"] == "create"
    delete = (s["state"] == "live") & (e["kind"] == "delete")
    restore = (s["state"] == "deleted") & (e["kind"] == "restore")
    in_time = F.when(e["ts"] <= s["at"] + span, "live").otherwise("none")
    return F.struct(
        F.when(create, "live")
        .when(delete, "deleted")
        .when(restore, in_time)
        .otherwise(s["state"])
        .alias("state"),
        F.when(delete, e["ts"]).when(~create & ~restore, s["at"]).alias("at"),
    )


def effect(events: Column, span: Column) -> Column:
    """What ordered events do to any state, as one fold (see EFFECT)."""

    def step(acc: Column, e: Column) -> Column:
        begun = acc["first"]["state"].isNotNull()
        opens = ~begun & (e["kind"] != "delete")
        first = F.struct(e["kind"].alias("state"), e["ts"].alias("at"))
        return F.struct(
            _after(acc["live"], e, span).alias("live"),
            _after(acc["none"], e, span).alias("none"),
            F.when(opens, first).otherwise(acc["first"]).alias("first"),
            F.when(begun, _after(acc["back"], e, span))
            .when(opens, _state("live"))
            .otherwise(acc["back"])
            .alias("back"),
        )

    nothing = F.struct(
        _state("live").alias("live"),
        _state("none").alias("none"),
        _state(None).alias("first"),
        _state(None).alias("back"),
    )
    return F.aggregate(events, nothing, step)


def current_state(
    events: DataFrame,
    now: Column,
    minutes: int = K.RETENTION_MINUTES,
    bucket: str = "1 hour",
) -> DataFrame:
    """(key, state, deleted_at): state is live, deleted or purged for each key in the log.

    events: key, kind, ts, event_id (orders equal times). The events of a key within one
    `bucket` of time are folded in one task; its length changes nothing in the result.
    """
    window = F.expr(f"INTERVAL {int(minutes)} MINUTES")
    runs = (
        events.groupBy("key", F.window("ts", bucket)["start"].alias("bucket"))
        .agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "kind"))).alias("events"))
        .select("key", "bucket", effect(F.col("events"), window).alias("effect"))
    )
    # One row per key and bucket is left to combine.
    ordered = runs.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "effect"))).alias("_runs")
    )
    start = F.struct(F.lit("none").alias("state"), F.lit(None).cast("timestamp").alias("at"))

    def combine(acc: Column, run: Column) -> Column:
        r, first = run["effect"], run["effect"]["first"]
        deleted = acc["state"] == "deleted"
        returns = (first["state"] == "create") | (first["at"] <= acc["at"] + window)
        return (
            F.when(acc["state"] == "live", r["live"])
            .when(deleted & first["state"].isNull(), acc)
            .when(deleted & returns, r["back"])
            .otherwise(r["none"])
        )

    folded = ordered.select("key", F.aggregate("_runs", start, combine).alias("s"))
    over = (F.col("s.state") == "deleted") & (F.col("s.at") < now - window)
    return folded.select(
        "key",
        F.when(over | (F.col("s.state") == "none"), "purged").otherwise(F.col("s.state")).alias(
            "state"
        ),
        F.when(~over, F.col("s.at")).alias("deleted_at"),
    )
