"""ST queries over the bound tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import state as S
from ...operators.windows import best_clip
from ...sources.scratch import scratch
from ...sources.versions import VersionedTables
from ...sources.writers import save_oem_documents
from ..bindings import AS_OF, EVENTS_AS_OF
from ..registry import query

_RES = "CASE relevance % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'no_content' WHEN 2 THEN 'timeout' WHEN 3 THEN 'blocked_403' ELSE 'other' END"
query(
    "ST-01", "b_track", "b_cand",
    sql=f"""WITH a AS (SELECT wo_number, count(*) AS n, max(published) AS last_at, arg_max(r, concat(CAST(published AS STRING), r)) AS r FROM (SELECT *, {_RES} AS r FROM b_cand) GROUP BY 1)
    SELECT coalesce(t.wo_number, a.wo_number) AS wo_number, CASE WHEN n IS NULL THEN t.status WHEN r = 'success' THEN 'found' ELSE 'searching' END AS status, coalesce(last_at, last_attempt_date) AS last_attempt_date, coalesce(attempt_count, 0) + coalesce(n, 0) AS attempt_count,
    CASE WHEN n IS NULL THEN retry_after WHEN r = 'no_content' THEN last_at + 4 WHEN r = 'timeout' THEN last_at + 1 WHEN r = 'blocked_403' THEN last_at + 2 END AS retry_after FROM b_track t FULL JOIN a ON t.wo_number = a.wo_number""",
)(lambda t, c: S.apply_attempts(t, c.select("wo_number", F.expr(_RES).alias("result"), F.col("published").alias("at"))))
_SKIP = f"""SELECT l.wo_number, c.status AS s, (coalesce(c.status IN ('approved', 'pending_review', 'rejected'), false) OR coalesce(t.status = 'found', false) OR coalesce(DATE '{AS_OF}' < retry_after, false)) AS skip
    FROM b_loan l LEFT JOIN (SELECT * FROM b_clip WHERE stage <> 'exported') c ON l.wo_number = c.wo_number LEFT JOIN b_track t ON l.wo_number = t.wo_number"""
query("ST-02", "b_loan", "b_clip", "b_track", sql=f"SELECT wo_number, CASE WHEN s IN ('approved', 'pending_review', 'rejected') THEN concat('already_', s) WHEN s IN ('no_content_found', 'processing_failed') THEN 'retry_cooldown' ELSE 'unknown' END AS skip_reason FROM ({_SKIP}) WHERE skip")(
    lambda l, c, t: S.skip_reasons(l, c.filter("stage <> 'exported'"), t, AS_OF)
)
query(
    "ST-03", "b_loan", "b_cand",
    sql="""SELECT outcome, count(*) AS loans FROM (SELECT CASE WHEN b.wo_number IS NULL THEN 'not_found' WHEN relevance >= 5 THEN 'stored' ELSE 'failed' END AS outcome FROM b_loan l LEFT JOIN b_best b ON l.wo_number = b.wo_number) GROUP BY 1""",
)(lambda l, c: S.loan_outcomes(l, best_clip(c)).groupBy("outcome").agg(F.count("*").alias("loans")))
query("ST-04", "b_clip", "b_track", sql="SELECT c.wo_number, CASE WHEN t.wo_number IS NOT NULL THEN 'pending_review' ELSE c.status END AS status, CASE WHEN t.wo_number IS NOT NULL THEN 'found' ELSE stage END AS stage, CASE WHEN t.wo_number IS NULL THEN sentiment END AS sentiment FROM b_clip c LEFT JOIN (SELECT wo_number FROM b_track WHERE attempt_count = 2) t ON c.wo_number = t.wo_number")(
    lambda c, t: S.set_stage(c.select("wo_number", "status", "stage", "sentiment"), t.filter("attempt_count = 2"), "pending_review", "found", ["sentiment"])
)
query(
    "ST-05", "b_clip",
    sql=f"""SELECT wo_number, CASE WHEN outlet_id < 50 THEN CASE WHEN wo_number % 2 = 0 THEN 'v2' ELSE 'v1' END ELSE version END AS version, CASE WHEN outlet_id < 50 AND wo_number % 2 = 0 THEN 'positive' ELSE sentiment END AS sentiment,
    CASE WHEN outlet_id < 50 THEN DATE '{AS_OF}' ELSE analysed END AS analysed, CASE WHEN outlet_id < 50 THEN 'sentiment_analyzed' ELSE stage END AS stage, 0 AS n_pros FROM b_clip""",
)(
    lambda c: S.apply_sentiment(
        c.select("wo_number", "version", "sentiment", "analysed", "stage"), c.filter("outlet_id < 50").select("wo_number", F.when(F.col("wo_number") % 2 == 0, "positive").alias("classification"), F.lit(None).cast("array<string>").alias("pros")), AS_OF
    ).withColumn("n_pros", F.size("pros")).drop("pros")
)
query("ST-06", "b_track", sql=f"SELECT wo_number, CASE WHEN retry_after > DATE '{AS_OF}' THEN retry_after END AS retry_after FROM b_track")(lambda t: S.reset_cooldowns(t, "past", AS_OF).select("wo_number", "retry_after"))
query("ST-07", "b_clip", sql=f"SELECT wo_number, CASE WHEN processed_date < DATE '{AS_OF}' - 1000 THEN 'removed' ELSE 'kept' END AS part FROM b_clip")(
    lambda c: S.split_by_age(c, "processed_date", 1000, AS_OF)[0].select("wo_number", F.lit("kept").alias("part")).unionByName(S.split_by_age(c, "processed_date", 1000, AS_OF)[1].select("wo_number", F.lit("removed").alias("part")))
)
query("ST-08", "b_clip", sql="SELECT wo_number, coalesce(version, 'v1') AS version, coalesce(relevance, 0) AS relevance FROM b_clip")(lambda c: S.backfill_defaults(c.select("wo_number", "version", "relevance"), {"version": "v1", "relevance": 0}))
query("ST-09", "b_clip", sql="SELECT wo_number, array_to_string(list_filter([CASE WHEN sentiment IS NOT NULL THEN 'sentiment' END, CASE WHEN version IS NOT NULL THEN 'version' END, CASE WHEN relevance IS NOT NULL THEN 'relevance' END], lambda x: x IS NOT NULL), ',') AS filled FROM b_clip WHERE stage = 'sentiment_analyzed' AND analysed IS NULL")(S.stage_audit)
query("ST-10", "b_run", sql=f"SELECT run_id, run_status = 'running' AND end_time < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTES AS was_stale, CASE WHEN run_status = 'running' AND end_time < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTES THEN 'failed' ELSE run_status END AS run_status FROM b_run")(
    lambda r: S.expire_stale(r.withColumnRenamed("end_time", "last_heartbeat"), AS_OF).select("run_id", "was_stale", "run_status")
)
query("ST-10b", "b_event", sql=f"SELECT worker_id, CASE WHEN max(ts) < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 5 MINUTES THEN 'offline' ELSE 'online' END AS status FROM b_event GROUP BY worker_id")(
    lambda e: S.offline_workers(e.groupBy("worker_id").agg(F.max("ts").alias("last_heartbeat")).withColumn("status", F.lit("online")), EVENTS_AS_OF).select("worker_id", "status")
)
query("ST-11", "b_run", sql=f"SELECT run_id, round((epoch(TIMESTAMP '{AS_OF}') - epoch(start_time::TIMESTAMP)) / 60.0, 2)::DOUBLE AS minutes_running, concat(CAST(successful_finds + failed_attempts AS BIGINT), '/', total_records) AS progress, round(100.0 * (successful_finds + failed_attempts) / total_records, 2)::DOUBLE AS percent FROM b_run WHERE run_status = 'running'")(
    lambda r: S.active_processes(r, AS_OF)
)


def _documents(p):
    """A document for each brand from its parts: features by part, attributes by type, drivers by size."""
    named = p.filter("p_name IS NOT NULL")
    of = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    return named.groupBy(F.col("p_brand").alias("model_id")).agg(
        F.first("p_brand").alias("make"), F.min("p_name").alias("model"), F.max("p_size").alias("year"), F.min("p_type").alias("positioning_statement"), F.max("p_type").alias("target_audience"),
        F.transform(of("p_partkey", "p_name", "p_type", "p_size"), lambda s: F.struct(s["p_name"].alias("feature"), s["p_type"].alias("category"), F.when(s["p_size"] % 2 == 0, "secondary").alias("priority"))).alias("key_features_intended"),
        F.array_sort(F.collect_set("p_type")).alias("brand_attributes_intended"),
        F.transform(F.array_sort(F.collect_set("p_size")), lambda s: F.struct(F.concat(F.lit("size "), s).alias("reason"), s.alias("priority"), F.lit("all").alias("target_audience"))).alias("purchase_drivers_intended"),
    )


@query(
    "ST-12", "part",
    sql="""WITH d AS (SELECT * FROM part WHERE p_name IS NOT NULL),
    n AS (SELECT p_brand AS model_id, 'features' AS kind, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INTEGER AS position, p_name AS item, CASE WHEN p_size % 2 = 0 THEN 'secondary' WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 3 THEN 'primary' ELSE 'secondary' END AS more FROM d
      UNION ALL SELECT p_brand, 'attributes', row_number() OVER (PARTITION BY p_brand ORDER BY p_type)::INTEGER, p_type, NULL FROM (SELECT DISTINCT p_brand, p_type FROM d)
      UNION ALL SELECT p_brand, 'drivers', row_number() OVER (PARTITION BY p_brand ORDER BY p_size)::INTEGER, concat('size ', p_size), CAST(p_size AS STRING) FROM (SELECT DISTINCT p_brand, p_size FROM d))
    SELECT model_id, 'models' AS kind, 0 AS position, min(p_name) AS item, concat(min(p_type), '/', max(p_type), '/', CAST(max(p_size) AS STRING)) AS more FROM (SELECT p_brand AS model_id, * FROM d) GROUP BY 1
    UNION ALL SELECT * FROM n""",
)
def _st12(p):
    """Documents with other content are saved first, for every second brand; the whole ones replace their children and update the parents."""
    tables = VersionedTables(p.sparkSession, scratch(p.sparkSession, "oem"))
    whole = _documents(p)
    first = whole.filter(F.crc32("model_id") % 2 == 0).withColumns({"model": F.lit("draft"), "key_features_intended": F.slice("key_features_intended", 1, 1), "brand_attributes_intended": F.array(F.lit("draft"))})
    save_oem_documents(tables, first)
    save_oem_documents(tables, whole)
    tables.expire(keep=1)
    text = lambda c: F.col(c).cast("string")
    rows = [
        tables.read("models").select("model_id", F.lit("models").alias("kind"), F.lit(0).alias("position"), F.col("model").alias("item"), F.concat_ws("/", "positioning_statement", "target_audience", text("year")).alias("more")),
        tables.read("features").select("model_id", F.lit("features").alias("kind"), "position", F.col("feature").alias("item"), F.col("priority").alias("more")),
        tables.read("attributes").select("model_id", F.lit("attributes").alias("kind"), "position", F.col("attribute").alias("item"), F.lit(None).cast("string").alias("more")),
        tables.read("drivers").select("model_id", F.lit("drivers").alias("kind"), "position", F.col("reason").alias("item"), text("priority").alias("more")),
    ]
    return reduce(DataFrame.unionByName, rows)
