"""Queries over the event log: jobs, watchers, windows; in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import jobs as J
from quire.session import read
from quire.streaming import events as S


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def _kind() -> Column:
    pairs = {"signup": "start", "view": "progress", "purchase": "success", "error": "failure"}
    out = F.lit("cancel")
    for name, kind in pairs.items():
        out = F.when(F.col("event_type") == name, kind).otherwise(out)
    return out


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's job from its events."""
    return J.job_states(_events(spark, sf_dir).withColumn("kind", _kind()), "user_id", "kind", "ts", "event_id")


def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by status with their attempts."""
    return job_states(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"), F.max("n_events").alias("most_events"))


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of each job: its progress events against the number named in its first event's JSON."""
    events = _events(spark, sf_dir)
    total = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999")).cast("long")
    per = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("done"), F.min_by(total, F.struct("ts", "event_id")).alias("total"))
    return per.select("user_id", "done", "total", F.round(J.progress(F.col("done"), F.col("total")), 6).alias("progress"))


def jobs_json_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed events joined to documents by the number in their JSON, and reconciled if the document is there."""
    failed = _events(spark, sf_dir).where("event_type = 'error'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("doc_id"))
    docs = read(spark, sf_dir, "documents").where("deleted_at is null").select("doc_id", "title")
    return failed.join(docs, "doc_id", "left").select("event_id", "doc_id", F.when(F.col("title").isNotNull(), "succeeded").otherwise("failed").alias("status"))


def latest_active_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each number in the JSON the latest event that is not an error, if any."""
    key = F.get_json_object("props", "$.k").cast("long").alias("k")
    events = _events(spark, sf_dir).select(key, "event_id", "ts", "event_type")
    latest = events.where("event_type <> 'error'").groupBy("k").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest_id"))
    return events.select("k").distinct().join(latest, "k", "left")


def expired_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups whose twelve hours were over at the user's last event (join with a residual condition)."""
    events = _events(spark, sf_dir)
    last = events.groupBy("user_id").agg(F.max("ts").alias("now"))
    tokens = events.where("event_type = 'signup'").select("user_id", "event_id", F.expr("ts + interval 12 hours").alias("expires_at"))
    return tokens.join(last, "user_id").where("expires_at <= now").groupBy("user_id").agg(F.count("*").alias("n_expired"), F.max("expires_at").alias("last_expiry"))


def throttled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a watcher accepts with a pause of six hours per user and type."""
    events = _events(spark, sf_dir).withColumn("path", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    return J.throttled(events, "path", "ts", 6 * 3600).select("event_id", "path", "ts")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value per six hours and type (tumbling windows)."""
    w = F.window("ts", "6 hours")
    return _events(spark, sf_dir).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("window_start"), "event_type", "n", "value")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, parted by pauses of more than a day."""
    found = J.sessions(_events(spark, sf_dir), "user_id", "ts", 86400)
    return found.groupBy("user_id", F.col("session_no").cast("int").alias("session_no")).agg(F.count("*").alias("n"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))


def sync_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External sync: the newest version of each item, and how many older ones were skipped."""
    items = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("version"), "event_type")
    return items.groupBy("user_id").agg(F.max_by("event_type", "version").alias("event_type"), F.max("version").alias("version"), (F.count("*") - 1).alias("n_skipped"))


def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event type of each user, merged batch by batch from the event stream."""
    return S.latest_states(S.source(spark, f"{sf_dir}/event[s].parquet"), "user_id", "ts", "event_id", "event_type")


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent replay: the stream sent twice, every event entered once, counted by type."""
    path = f"{sf_dir}/event[s].parquet"
    twice = S.source(spark, path).unionByName(S.source(spark, path)).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    # A replay that comes within the delay is recognised; older state is dropped.
    once = twice.withWatermark("ts", "7 days").dropDuplicatesWithinWatermark(["event_id"]).drop("ts")
    return S.run(once).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("sum_id"))


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watcher's throttle on the stream, with state."""
    events = S.source(spark, f"{sf_dir}/event[s].parquet").withColumn("path", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    return S.run(S.throttle(events, "path", "ts", 6 * 3600)).select("event_id", "path", "ts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    own = (job_states, job_status_counts, job_progress, jobs_json_join, latest_active_job, expired_capabilities, throttled_events, event_windows, event_sessions, sync_by_version, stream_latest_state, stream_replay, stream_throttle)
    return {f.__name__: f for f in own}


KINDS = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'cancel' END"
STATES = f"""WITH k AS (SELECT *, {KINDS} AS kind FROM events),
  j AS (SELECT user_id, arg_max(kind, (ts, event_id)) AS last, count(*) FILTER (kind = 'start') AS attempts, min(ts) FILTER (kind = 'start') AS first_started_at, max(ts) FILTER (kind IN ('success', 'failure', 'cancel')) AS last_end, count(*) AS n_events FROM k GROUP BY 1),
  s AS (SELECT user_id, CASE last WHEN 'success' THEN 'succeeded' WHEN 'failure' THEN 'failed' WHEN 'cancel' THEN 'canceled' ELSE 'running' END AS status, attempts, first_started_at,
    CASE WHEN last IN ('success', 'failure', 'cancel') THEN last_end END AS finished_at, n_events FROM j)
"""


def oracle_sql() -> dict[str, str]:
    """Name -> SQL."""
    k = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    return {
        "job_states": STATES + "SELECT * FROM s",
        "job_status_counts": STATES + "SELECT status, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts, max(n_events) AS most_events FROM s GROUP BY 1",
        "job_progress": f"WITH j AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS done, arg_min({k}, (ts, event_id)) AS total FROM events GROUP BY 1) SELECT user_id, done, total, CASE WHEN total > 0 THEN round(least(1.0::DOUBLE, done / CAST(total AS DOUBLE)), 6) ELSE 0 END AS progress FROM j",
        "jobs_json_join": f"SELECT event_id, {k} AS doc_id, CASE WHEN title IS NOT NULL THEN 'succeeded' ELSE 'failed' END AS status FROM events e LEFT JOIN documents d ON d.doc_id = {k} AND d.deleted_at IS NULL WHERE event_type = 'error'",
        "latest_active_job": f"SELECT {k} AS k, arg_max(event_id, (ts, event_id)) FILTER (event_type <> 'error') AS latest_id FROM events GROUP BY 1",
        "expired_capabilities": "WITH l AS (SELECT user_id, max(ts) AS now_ FROM events GROUP BY 1) SELECT e.user_id, count(*) AS n_expired, max(ts + INTERVAL 12 HOUR) AS last_expiry FROM events e JOIN l ON l.user_id = e.user_id AND ts + INTERVAL 12 HOUR <= now_ WHERE event_type = 'signup' GROUP BY 1",
        "event_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
        "event_sessions": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, CAST(sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS session_no FROM g)
SELECT user_id, session_no, count(*) AS n, min(ts) AS started_at, max(ts) AS ended_at FROM s GROUP BY 1, 2""",
        "sync_by_version": "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS version, count(*) - 1 AS n_skipped FROM events GROUP BY 1",
        "stream_latest_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY 1",
        "stream_replay": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS sum_id FROM events GROUP BY 1",
    }
