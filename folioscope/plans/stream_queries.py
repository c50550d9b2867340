"""Registered queries: lifecycle logs, status windows and the streaming jobs."""

from pyspark.sql import functions as F

from folioscope.operators import lifecycle as L
from folioscope.plans import tables as T
from folioscope.plans.registry import query
from folioscope.session import scratch_dir
from folioscope.sources.captures import read_capture_stream
from folioscope.streaming import admission as SA
from folioscope.streaming import lifecycle as SL
from folioscope.streaming import monitor as SM

KINDS = {"signup": "create", "error": "delete", "click": "restore"}
END = "2024-02-01 00:00:00"
MINUTES = 60

# State by windows over the whole log of a key: fine for checking, not for a skewed log.
_LOG = (
    "SELECT CAST(user_id AS STRING) AS key, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'restore' END AS kind, ts, event_id "
    "FROM events WHERE event_type IN ('signup', 'error', 'click')"
)
_STATE = f"""
WITH log AS ({_LOG}),
epochs AS (SELECT *, SUM(CASE WHEN kind = 'create' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS epoch,
  MAX(CASE WHEN kind = 'create' THEN 1 ELSE 0 END) OVER (PARTITION BY key) AS born FROM log),
latest AS (SELECT * FROM epochs e WHERE epoch = (SELECT MAX(epoch) FROM epochs x WHERE x.key = e.key)),
runs AS (SELECT *, LAG(kind) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM latest),
starts AS (SELECT *, LEAD(kind) OVER (PARTITION BY key ORDER BY ts, event_id) AS next_kind, LEAD(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS next_ts
  FROM runs WHERE before IS NULL OR kind <> before)
SELECT key, CASE WHEN MAX(born) = 0 OR BOOL_OR(kind = 'delete' AND next_kind = 'restore' AND next_ts > ts + INTERVAL '{MINUTES}' MINUTE)
  OR BOOL_OR(kind = 'delete' AND next_kind IS NULL AND ts < TIMESTAMP '{END}' - INTERVAL '{MINUTES}' MINUTE) THEN 'purged'
  WHEN BOOL_OR(kind = 'delete' AND next_kind IS NULL) THEN 'deleted' ELSE 'live' END AS state FROM starts GROUP BY key
"""


def log(spark, sf_dir):
    return L.lifecycle_events(T.given(spark, sf_dir).table("events"), KINDS)


@query(_STATE)
def bookmark_states(spark, sf_dir):
    end = F.lit(END).cast("timestamp")
    return L.current_state(log(spark, sf_dir), end, MINUTES).select("key", "state")


@query(
    "SELECT EPOCH_MS(TIME_BUCKET(INTERVAL '1 hour', ts)) AS window_start_ms, event_type AS status, COUNT(*) AS n FROM events GROUP BY 1, 2"
)
def status_per_hour(spark, sf_dir):
    events = T.given(spark, sf_dir).table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = SM.status_windows(events, "1 hour", "event_type")
    return windows.select(F.unix_millis("window_start").alias("window_start_ms"), "status", "n")


@query(
    "SELECT key, EPOCH_US(MIN(ts)) // 1000 AS session_start_ms, COUNT(*) AS n FROM (SELECT *, SUM(gap) OVER (PARTITION BY key ORDER BY ts, event_id) AS s FROM "
    "(SELECT CAST(user_id AS STRING) AS key, ts, event_id, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6' HOUR THEN 0 ELSE 1 END AS gap FROM events) e) x GROUP BY key, s"
)
def activity_sessions(spark, sf_dir):
    events = T.given(spark, sf_dir).table("events").select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")
    )
    sessions = SM.status_sessions(events, "6 hours")
    return sessions.select("key", F.unix_millis("session_start").alias("session_start_ms"), "n")


def _event_stream(spark, sf_dir):
    schema = T.given(spark, sf_dir).table("events").schema
    return read_capture_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet")


def _drain(spark, stream, mode="append"):
    """Run a stream over what is there, into a table in the shared scratch folder."""
    base = scratch_dir(spark)
    run = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{base}/rows")
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query(
    "SELECT EPOCH_MS(w) AS window_start_ms, event_type AS status, n FROM (SELECT TIME_BUCKET(INTERVAL '1 day', ts) AS w, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2) x "
    "WHERE w + INTERVAL '1' DAY <= (SELECT MAX(ts) - INTERVAL '10' MINUTE FROM events)"
)
def streamed_status_per_day(spark, sf_dir):
    events = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _drain(spark, SM.status_windows(events, "1 day", "event_type"))
    return rows.select(F.unix_millis("window_start").alias("window_start_ms"), "status", "n")


@query(
    "SELECT CONCAT('https://e.example/', CAST(user_id AS STRING)) AS normalized_url, 1 AS n FROM events GROUP BY user_id"
)
def streamed_admission(spark, sf_dir):
    events = _event_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("HTTPS://E.example/"), F.col("user_id").cast("string"), F.lit("#"), F.col("event_id").cast("string")).alias("url"),
    )
    rows = _drain(spark, SM.admit_stream(events, "60 days").select("normalized_url"))
    return rows.groupBy("normalized_url").agg(F.count("*").alias("n"))


# Requests for one address a user; every fifth is no address. Users have a live bookmark, a deleted
# one or none.
_ASKED = (
    "SELECT CAST(event_id AS STRING) AS request_id, ts, CASE WHEN event_id % 5 = 0 THEN 'ftp://e.example/' "
    "ELSE CONCAT('HTTPS://E.example/', CAST(user_id AS STRING), '#', CAST(event_id AS STRING)) END AS url FROM {events}"
)
_HELD = (
    "SELECT DISTINCT CONCAT('b', CAST(user_id AS STRING)) AS id, CONCAT('https://e.example/', CAST(user_id AS STRING)) AS normalized_url, "
    "CASE WHEN user_id % 3 = 1 THEN TIMESTAMP '2020-01-01 00:00:00' END AS deleted_at FROM events WHERE user_id % 3 < 2"
)


@query(
    "SELECT e.event_id, CASE WHEN e.event_id % 5 = 0 THEN 'UNSUPPORTED_PROTOCOL' WHEN e.user_id % 3 = 0 OR turn > 1 THEN 'DUPLICATE_URL' ELSE 'admitted' END AS outcome, "
    "CASE WHEN e.event_id % 5 > 0 AND e.user_id % 3 = 1 AND turn = 1 THEN CONCAT('b', CAST(e.user_id AS STRING)) END AS replaced_id "
    "FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_id % 5 = 0 ORDER BY ts, CAST(event_id AS STRING)) AS turn FROM events) e"
)
def streamed_admission_verdicts(spark, sf_dir):
    SL.use_rocksdb(spark)
    stored = T.table(spark, sf_dir, _HELD)
    _event_stream(spark, sf_dir).createOrReplaceTempView("event_stream")
    rows = _drain(spark, SA.admission_verdicts(spark.sql(_ASKED.format(events="event_stream")), stored))
    return rows.select(F.col("request_id").cast("bigint").alias("event_id"), "outcome", "replaced_id")


# The log replayed in order, one event of each key a round, up to the last watermark.
_REPLAY = f"""
WITH RECURSIVE log AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY ts, event_id) AS turn FROM ({_LOG}) l),
mark AS (SELECT EPOCH_US(MAX(ts)) // 1000 - 600000 AS watermark FROM log),
due AS (SELECT log.* FROM log, mark WHERE EPOCH_US(ts) // 1000 <= watermark),
replay AS (
  SELECT DISTINCT key, 0::BIGINT AS turn, NULL::BIGINT AS event_id, NULL::VARCHAR AS kind, NULL::VARCHAR AS outcome, 'none' AS state, NULL::TIMESTAMP AS since, NULL::TIMESTAMP AS purged_at FROM due
  UNION ALL
  SELECT key, turn, event_id, kind,
    CASE WHEN kind = 'create' AND before <> 'live' OR kind = 'delete' AND before = 'live' OR kind = 'restore' AND before = 'deleted' THEN 'applied' ELSE 'rejected' END,
    CASE WHEN kind = 'create' OR kind = 'restore' AND before = 'deleted' THEN 'live' WHEN kind = 'delete' AND before = 'live' THEN 'deleted' ELSE before END,
    CASE WHEN kind = 'delete' AND before = 'live' THEN ts ELSE since END,
    CASE WHEN before <> state THEN since + INTERVAL '{MINUTES}' MINUTE END
  FROM (SELECT d.key, d.turn, d.event_id, d.kind, d.ts, r.since, r.state,
          CASE WHEN r.state = 'deleted' AND d.ts > r.since + INTERVAL '{MINUTES}' MINUTE THEN 'none' ELSE r.state END AS before
        FROM replay r JOIN due d ON d.key = r.key AND d.turn = r.turn + 1) x),
last AS (SELECT * FROM replay r WHERE turn = (SELECT MAX(turn) FROM due d WHERE d.key = r.key)),
outcomes AS (
  SELECT key, event_id, kind, outcome, NULL::BIGINT AS purged_ms FROM replay WHERE turn > 0
  UNION ALL SELECT key, NULL, 'purge', 'purged', EPOCH_US(purged_at) // 1000 FROM replay WHERE purged_at IS NOT NULL
  UNION ALL SELECT key, NULL, 'purge', 'purged', EPOCH_US(since + INTERVAL '{MINUTES}' MINUTE) // 1000 FROM last, mark
    WHERE state = 'deleted' AND EPOCH_US(since + INTERVAL '{MINUTES}' MINUTE) // 1000 < watermark)
"""


def _outcomes(spark, sf_dir):
    T.given(spark, sf_dir)
    SL.use_rocksdb(spark)
    events = L.lifecycle_events(_event_stream(spark, sf_dir), KINDS)
    return _drain(spark, SL.lifecycle_stream(events, MINUTES))


@query(_REPLAY + "SELECT kind, outcome, COUNT(*) AS n FROM outcomes GROUP BY kind, outcome")
def streamed_lifecycle(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy("kind", "outcome").agg(F.count("*").alias("n"))


@query(_REPLAY + "SELECT key, event_id, kind, outcome, purged_ms FROM outcomes")
def streamed_lifecycle_outcomes(spark, sf_dir):
    purged = F.when(F.col("kind") == "purge", F.unix_millis("ts"))
    return _outcomes(spark, sf_dir).select("key", "event_id", "kind", "outcome", purged.alias("purged_ms"))
