"""SS queries: the event stream run to the end of the data, against the batch SQL of the same windows.

Append mode gives a window once the watermark has passed it, so the last windows before the end of the
data stay open; the SQL leaves out the same ones.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ...sources.scratch import scratch
from ...sources.versions import VersionedTables
from ...streaming import streams as S
from ..bindings import duck
from ..registry import QUERIES, SQL


def _add(name, f, sql):
    QUERIES[name] = f
    SQL[name] = duck(sql)


_CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTES FROM b_event)"
_add(
    "SS-01", lambda s, d: S.run_available(S.stream_throughput(S.event_stream(s, d))).withColumn("slot", F.col("slot").cast("timestamp_ntz")),
    f"SELECT * FROM (SELECT date_trunc('minute', ts) AS slot, count(*) AS events, count(*) FILTER (level = 'ERROR') AS errors FROM b_event GROUP BY 1) WHERE slot + INTERVAL 1 MINUTE <= {_CLOSED}",
)
_add(
    "SS-02", lambda s, d: S.run_available(S.stream_activity(S.event_stream(s, d))).withColumn("window_end", F.col("window_end").cast("timestamp_ntz")),
    f"SELECT window_end, events, CASE WHEN events >= 2 THEN 'active' ELSE 'idle' END AS verdict FROM (SELECT date_trunc('minute', ts) + to_minutes(i) AS window_end, count(*) AS events FROM b_event, (SELECT unnest([1, 2, 3, 4, 5]) AS i) GROUP BY 1) WHERE window_end <= {_CLOSED}",
)
_add(
    "SS-03", lambda s, d: S.run_available(S.stream_bursts(S.event_stream(s, d))).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")}),
    f"""WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY worker_id ORDER BY ts) + INTERVAL 5 MINUTES THEN 0 ELSE 1 END AS fresh FROM b_event),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY worker_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
    SELECT worker_id, min(ts) AS started, max(ts) + INTERVAL 5 MINUTES AS ended, count(*) AS events FROM n GROUP BY worker_id, burst HAVING max(ts) + INTERVAL 5 MINUTES <= {_CLOSED}""",
)
_add(
    "SS-04b", lambda s, d: S.run_available(S.stream_stale(S.event_stream(s, d), "2024-01-31", "48 hours"), "complete").withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz")),
    "SELECT worker_id, max(ts) AS last_seen, max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 48 HOURS AS stale FROM b_event GROUP BY 1",
)


def _silences(spark, sf_dir):
    with S.keyed_state(spark):
        return S.run_available(S.stream_silences(S.event_stream(spark, sf_dir), timedelta(hours=48))).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_seen", "stale_at")})


_add(
    "SS-04", _silences,
    f"""SELECT worker_id, ts AS last_seen, ts + INTERVAL 48 HOURS AS stale_at FROM (SELECT worker_id, ts, lead(ts) OVER (PARTITION BY worker_id ORDER BY ts) AS next FROM b_event)
    WHERE (next IS NULL OR next > ts + INTERVAL 48 HOURS) AND ts + INTERVAL 48 HOURS <= {_CLOSED}""",
)

#: What came of an attempt, by the level of its log line.
_RESULT = "CASE level WHEN 'ERROR' THEN 'crawl_failed' WHEN 'CRITICAL' THEN 'blocked_403' WHEN 'WARNING' THEN 'no_content' ELSE 'success' END"


def _attempts(spark, sf_dir):
    """The log as attempts, each batch published as a version of the tracking table."""
    base = scratch(spark, "attempts")
    tables = VersionedTables(spark, f"{base}/tables")
    log = S.event_stream(spark, sf_dir).select(F.col("worker_id").alias("wo_number"), F.expr(_RESULT).alias("result"), F.col("ts").alias("at"))
    S.stream_attempts(log, tables, "tracking", f"{base}/state").awaitTermination()
    tables.expire(keep=1)
    return tables.read("tracking").withColumn("last_attempt_date", F.col("last_attempt_date").cast("timestamp_ntz"))


_add(
    "SS-05", _attempts,
    f"""WITH a AS (SELECT worker_id AS wo_number, ts, {_RESULT} AS result FROM b_event),
    l AS (SELECT wo_number, count(*) AS attempt_count, max(ts) AS tried_at, max_by(result, {{'t': ts, 'r': result}}) AS result FROM a GROUP BY wo_number)
    SELECT wo_number, CASE WHEN result = 'success' THEN 'found' ELSE 'searching' END AS status, tried_at AS last_attempt_date, attempt_count,
    CAST(tried_at AS DATE) + CASE result WHEN 'no_content' THEN 4 WHEN 'blocked_403' THEN 2 WHEN 'crawl_failed' THEN 1 END AS retry_after FROM l""",
)
_add("SS-06", lambda s, d: S.run_available(S.stream_first_by_key(S.event_stream(s, d).unionByName(S.event_stream(s, d)), "event_id")).select("event_id", "worker_id"), "SELECT event_id, worker_id FROM b_event")
_add(
    "SS-07", lambda s, d: S.run_available(S.stream_error_alerts(S.event_stream(s, d), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("worker_id"), "c_name"))).select("event_id", "level", "c_name"),
    "SELECT event_id, level, c_name FROM b_event JOIN customer ON worker_id = c_custkey WHERE level IN ('ERROR', 'CRITICAL')",
)
