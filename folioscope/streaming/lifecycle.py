"""Delete, undo and purge as keyed state with event-time timers."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioscope import constants as K

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME_ROWS = 10_000
OUTCOMES = "key string, ts timestamp, event_id long, kind string, outcome string"


class Lifecycle(StatefulProcessor):
    """Events wait for the watermark, so they are applied in event-time order.

    State per key is small: one status, one time, and the events not yet due, in a list. The
    rows that a batch brings are appended at once and set one timer, at the earliest of them. The
    first timer of a key that fires in a batch applies all events that are due, in order, and
    sets one for the earliest that is left; other timers of the key find nothing to do. So the
    calls to the state store grow with the keys of a batch, not with its events.
    """

    def __init__(self, minutes: int):
        self.window_us = minutes * 60 * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "state string, at long, upto long")
        self.due = handle.getListState("due", "events array<struct<ts:long,id:long,kind:string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = []
        for frame in rows:
            stamps = frame["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            events = list(zip(stamps, frame["event_id"].tolist(), frame["kind"].tolist()))
            self.due.appendValue((events,))
            earliest.append(min(stamps) // 1000)
        if earliest:
            self.handle.registerTimer(min(earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        state, at, upto = self.status.get() if self.status.exists() else ("none", 0, -1)
        if upto >= watermark:
            return
        due, later = [], []
        for (events,) in self.due.get():
            for event in events:
                (due if event[0] // 1000 <= watermark else later).append(tuple(event))
        if due:
            self.due.clear()
            for start in range(0, len(later), FRAME_ROWS):
                self.due.appendValue((later[start : start + FRAME_ROWS],))
        if later:
            self.handle.registerTimer(min(event[0] for event in later) // 1000)
        out = []
        for ts, event_id, kind in sorted(due):
            if state == "deleted" and ts - at > self.window_us:
                out.append((at + self.window_us, None, "purge", "purged"))
                state = "none"
            outcome = "applied"
            if kind == "create" and state != "live":
                state = "live"
            elif kind == "delete" and state == "live":
                state, at = "deleted", ts
            elif kind == "restore" and state == "deleted":
                state = "live"
            else:
                outcome = "rejected"
            out.append((ts, event_id, kind, outcome))
        if state == "deleted":
            # No event up to the watermark is left, so the window closed without a restore.
            deadline = (at + self.window_us) // 1000
            if deadline < watermark:
                out.append((at + self.window_us, None, "purge", "purged"))
                state = "none"
            else:
                self.handle.registerTimer(deadline + 1)
        self.status.update((state, at, watermark))
        for start in range(0, len(out), FRAME_ROWS):
            ts, event_ids, kinds, outcomes = zip(*out[start : start + FRAME_ROWS])
            frame = {
                "key": [key[0]] * len(ts),
                "ts": list(pd.to_datetime(ts, unit="us")),
                "event_id": event_ids,
                "kind": kinds,
                "outcome": outcomes,
            }
            # Plain objects: batches of several frames must stay one Arrow array.
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in frame.items()})

    def close(self) -> None:
        pass


def lifecycle_stream(
    events: DataFrame, minutes: int = K.RETENTION_MINUTES, lateness: str = "10 minutes"
) -> DataFrame:
    """Outcome of each event plus a purge row per expired undo window.

    events: streaming (key, kind, ts, event_id).
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=Lifecycle(minutes),
            outputStructType=OUTCOMES,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
