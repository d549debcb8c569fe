"""JN queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import joins as J
from ..bindings import AS_OF, EVENTS_AS_OF
from ..registry import query

query("JN-01", "b_clip", "b_run", sql="SELECT wo_number, c.run_id, run_name, run_status, status FROM b_clip c LEFT JOIN b_run r ON c.run_id = r.run_id")(
    lambda c, r: J.clips_dashboard(c, r).select("wo_number", "run_id", "run_name", "run_status", "status")
)
_OEM = "(SELECT DISTINCT p_brand AS make, p_name AS model, 1995 + p_size % 7 AS year, p_type AS trim_wanted FROM part)"
query("JN-02", "b_clip", "part", sql=f"SELECT wo_number, c.make, c.model, year, trim_wanted FROM b_clip c JOIN {_OEM} o ON c.make = o.make AND c.model = o.model AND year(published_date) = o.year")(
    lambda c, p: J.oem_vs_media(c, p.select(F.col("p_brand").alias("make"), F.col("p_name").alias("model"), (1995 + F.col("p_size") % 7).alias("year"), F.col("p_type").alias("trim_wanted")).distinct()).select("wo_number", "make", "model", "year", "trim_wanted")
)
query("JN-03", "b_clip", "part", sql="SELECT wo_number, c.make, model, oem_model FROM b_clip c JOIN (SELECT DISTINCT p_brand AS make, split_part(p_name, ' ', 1) AS oem_model FROM part WHERE p_type <> 'SMALL') o ON c.make = o.make AND starts_with(model, oem_model)")(
    lambda c, p: J.prefix_join(c, p.filter("p_type <> 'SMALL'").select(F.col("p_brand").alias("make"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("model")).distinct()).select("wo_number", "make", "model", "oem_model")
)
query(
    "JN-04", "b_loan", "b_outlet",
    sql="""SELECT wo_number, coalesce(own, found) AS person_id FROM (SELECT wo_number, CASE WHEN wo_number % 2 = 0 THEN person_id END AS own, concat('Reporter Nation_', CAST(person_id % 30 AS STRING)) AS n FROM b_loan)
    LEFT JOIN (SELECT replace(reporter_name, 'NATION', 'Nation') AS n2, min(person_id) AS found FROM b_outlet GROUP BY 1) ON n = n2""",
)(
    lambda l, o: J.contact_to_person(
        l.select("wo_number", F.when(F.col("wo_number") % 2 == 0, F.col("person_id")).alias("person_id"), F.concat(F.lit("  reporter   nation_"), (F.col("person_id") % 30).cast("string")).alias("contact")), o
    ).select("wo_number", "person_id")
)
query(
    "JN-05", "b_cand", "b_outlet",
    sql="""SELECT wo_number, url_pos, part_id, price, o.outlet_id FROM b_cand c JOIN b_outlet o ON o.person_id = c.outlet_id % 25
    AND (concat('site', CAST(c.outlet_id AS STRING), '.com') = replace(o.outlet_url, 'http://', '') OR ends_with(concat('site', CAST(c.outlet_id AS STRING), '.com'), concat('.', replace(o.outlet_url, 'http://', ''))))""",
)(lambda c, o: J.url_outlet_join(c.select("wo_number", "url_pos", "part_id", "price", "url", (F.col("outlet_id") % 25).alias("person_id")), o).select("wo_number", "url_pos", "part_id", "price", "outlet_id"))
query(
    "JN-06", "b_clip", "b_outlet",
    sql="""WITH c AS (SELECT wo_number, person_id % 25 AS person_id, CASE wo_number % 3 WHEN 0 THEN concat('SUPPLIER#', lpad(CAST(wo_number % 100 AS STRING), 9, '0')) ELSE concat('The Supplier#', lpad(CAST(wo_number % 100 AS STRING), 9, '0'), ' Group') END AS affiliation FROM b_loan),
    m AS (SELECT wo_number, outlet_name, row_number() OVER (PARTITION BY wo_number ORDER BY CASE WHEN lower(outlet_name) = lower(affiliation) THEN 1 ELSE 2 END, outlet_id) AS rn
          FROM c JOIN b_outlet o ON o.person_id = c.person_id WHERE contains(lower(affiliation), lower(outlet_name)))
    SELECT c.wo_number, outlet_name AS matched_outlet FROM c LEFT JOIN m ON c.wo_number = m.wo_number AND rn = 1""",
)(
    lambda l, o: J.match_outlet(
        l.select("wo_number", (F.col("person_id") % 25).alias("person_id"), F.when(F.col("wo_number") % 3 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("wo_number") % 100).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("The Supplier#"), F.lpad((F.col("wo_number") % 100).cast("string"), 9, "0"), F.lit(" Group"))).alias("affiliation")), o
    ).select("wo_number", "matched_outlet")
)
_TOUCH = "(contains(lower(model), lower(feature)) OR contains(lower(feature), lower(model)))"
query("JN-07", "b_cand", "b_intent", sql=f"SELECT wo_number, url_pos, part_id, price, (SELECT arg_min(lower(feature), (length(feature), lower(feature))) FROM b_intent i WHERE i.make = c.make AND {_TOUCH}) AS feature FROM b_cand c")(
    lambda c, i: J.substring_first_match(c, i.withColumn("place", F.length("feature")), ["make"], "model", "feature", "place").select("wo_number", "url_pos", "part_id", "price", "feature")
)
query("JN-08", "b_cand", "b_intent", sql=f"SELECT DISTINCT c.make, lower(model) AS model, lower(feature) AS feature FROM b_cand c JOIN b_intent i ON i.make = c.make AND {_TOUCH}")(
    lambda c, i: J.substring_all_matches(c, i, ["make"], "model", "feature")
)
_SYN = [("round", "ring"), ("round", "widget"), ("tool", "bolt"), ("tool", "gear"), ("tool", "small")]
query(
    "JN-09", "b_cand", "b_intent",
    sql=f"""WITH syn(g, t) AS (VALUES {', '.join(str(x) for x in _SYN)}), p AS (SELECT DISTINCT c.make, lower(model) AS model, lower(feature) AS feature FROM b_cand c JOIN b_intent i ON i.make = c.make)
    SELECT DISTINCT make, model, feature FROM p WHERE {_TOUCH} OR EXISTS (SELECT 1 FROM syn a, syn b WHERE a.g = b.g AND contains(p.model, a.t) AND contains(p.feature, b.t))""",
)(lambda c, i: J.semantic_match(c, i, c.sparkSession.createDataFrame(_SYN, "group string, term string"), ["make"], "model", "feature"))
query("JN-10", "b_clip", "b_track", sql="SELECT wo_number, status FROM b_clip WHERE wo_number IN (SELECT wo_number FROM b_track WHERE status = 'found')")(
    lambda c, t: J.keep_keys(c, t.filter("status = 'found'"), ["wo_number"]).select("wo_number", "status")
)
query("JN-11", "b_cand", "b_intent", sql=f"SELECT DISTINCT make, lower(feature) AS feature FROM b_intent i WHERE NOT EXISTS (SELECT 1 FROM b_cand c WHERE c.make = i.make AND c.relevance = 10 AND c.price < 3000 AND {_TOUCH})")(
    lambda c, i: J.not_mentioned(i, c.filter("relevance = 10 AND price < 3000"), ["make"], "feature", "model")
)
query(
    "JN-12", "b_track", "b_clip",
    sql="""SELECT coalesce(t.wo_number, c.wo_number) AS wo_number, coalesce(c.status, t.status) AS status, coalesce(attempt_count, 0) + coalesce(n, 0) AS attempt_count, last_attempt_date
    FROM b_track t FULL JOIN (SELECT wo_number, status, 1 AS n FROM b_clip WHERE status = 'no_content_found') c ON t.wo_number = c.wo_number""",
)(lambda t, c: J.merge_by_key(t.select("wo_number", "status", "attempt_count", "last_attempt_date"), c.filter("status = 'no_content_found'").select("wo_number", "status", F.lit(1).alias("attempt_count")), ["wo_number"], ["attempt_count"]))
query(
    "JN-13", "b_clip",
    sql="""WITH c AS MATERIALIZED (SELECT wo_number, make, model FROM b_clip), p AS (SELECT CASE WHEN wo_number % 7 = 0 THEN NULL WHEN wo_number % 5 = 0 THEN -wo_number ELSE wo_number END AS wo_number, wo_number AS src, CASE WHEN wo_number % 2 = 0 THEN upper(make) END AS make, model FROM c WHERE make IS NOT NULL)
    SELECT p.wo_number, CASE WHEN p.wo_number IS NULL THEN 'invalid' WHEN b.wo_number IS NULL THEN 'not_found' WHEN (p.make IS NULL OR p.make = b.make) AND (p.model IS NULL OR p.model = b.model) THEN 'no_change' ELSE 'updated' END AS outcome,
    coalesce(p.make, b.make) AS make, coalesce(p.model, b.model) AS model FROM p LEFT JOIN c b ON p.wo_number = b.wo_number""",
)(
    lambda c: J.patch_columns(
        c.select("wo_number", "make", "model"),
        c.filter("make IS NOT NULL").select(F.when(F.col("wo_number") % 7 == 0, F.lit(None)).when(F.col("wo_number") % 5 == 0, -F.col("wo_number")).otherwise(F.col("wo_number")).alias("wo_number"), F.when(F.col("wo_number") % 2 == 0, F.upper("make")).alias("make"), "model"),
        ["wo_number"], ["make", "model"],
    )
)
query(
    "JN-14", "b_clip", "b_cand",
    sql="""SELECT c.wo_number, coalesce(s.outlet_id, c.outlet_id) AS outlet_id FROM b_clip c LEFT JOIN (SELECT wo_number, outlet_id FROM (SELECT *, row_number() OVER (PARTITION BY wo_number ORDER BY price DESC, outlet_id DESC) AS rn FROM b_cand WHERE relevance > 3) WHERE rn = 1) s ON c.wo_number = s.wo_number""",
)(lambda c, s: J.backfill(c.select("wo_number", "outlet_id"), s.filter("relevance > 3").withColumn("_o", F.struct("price", "outlet_id")), ["wo_number"], ["outlet_id"], "_o"))
query("JN-15", "b_clip", "b_track", sql=f"SELECT c.wo_number, retry_after, attempt_count, CASE WHEN DATE '{AS_OF}' < retry_after THEN 'in_cooldown' ELSE 'ready' END AS retry_status FROM b_clip c LEFT JOIN b_track t ON c.wo_number = t.wo_number")(
    lambda c, t: J.with_retry_status(c, t, AS_OF).select("wo_number", "retry_after", "attempt_count", "retry_status")
)
query("JN-16", "b_event", "customer", sql="SELECT event_id, ts, level, c_name FROM b_event JOIN customer ON worker_id = c_custkey WHERE level IN ('ERROR', 'CRITICAL') AND ts > TIMESTAMP '2024-01-31' - INTERVAL 12 HOURS ORDER BY ts DESC, event_id LIMIT 20")(
    lambda e, c: J.error_log(e, c.withColumnRenamed("c_custkey", "worker_id"), EVENTS_AS_OF, "12 hours").select("event_id", "ts", "level", "c_name")
)
query(
    "JN-17", "b_clip", "b_run",
    sql="""WITH r AS (SELECT run_id, first_value(run_id) OVER (PARTITION BY run_name ORDER BY CASE run_status WHEN 'completed' THEN 1 WHEN 'running' THEN 2 ELSE 3 END, total_records DESC, run_id) AS keep_id FROM b_run)
    SELECT wo_number, c.run_id, keep_id AS kept_run_id FROM b_clip c JOIN r ON c.run_id = r.run_id""",
)(lambda c, r: J.repoint_duplicates(c, r.withColumn("start_time", F.to_timestamp(F.lit("1995-01-01")))).select("wo_number", "run_id", "kept_run_id"))
query(
    "JN-18", "part",
    sql="""WITH r AS (SELECT DISTINCT p_brand AS url, lower(p_name) AS model FROM part WHERE p_type <> 'ECONOMY'), s AS (SELECT DISTINCT p_brand AS url, lower(split_part(p_name, ' ', 1)) AS section FROM part WHERE p_type = 'ECONOMY'),
    m AS (SELECT r.url, model, section FROM r JOIN s ON r.url = s.url AND (contains(model, section) OR contains(section, model)))
    SELECT url, model, min(section) AS section, 'matched' AS match FROM m GROUP BY 1, 2 UNION ALL SELECT url, model, NULL, 'unmatched' FROM r WHERE (url, model) NOT IN (SELECT (url, model) FROM m)
    UNION ALL SELECT url, NULL, section, 'bonus' FROM s WHERE (url, section) NOT IN (SELECT (url, section) FROM m)""",
)(lambda p: J.match_sections(p.filter("p_type <> 'ECONOMY'").select(F.col("p_brand").alias("url"), F.col("p_name").alias("model")), p.filter("p_type = 'ECONOMY'").select(F.col("p_brand").alias("url"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("section"))))
query(
    "JN-19", "b_loan", "b_clip", "b_track",
    sql=f"""SELECT l.wo_number, c.status AS clip_status, t.status AS track_status, retry_after, NOT (coalesce(c.status IN ('approved', 'pending_review', 'rejected'), false) OR coalesce(t.status = 'found', false) OR coalesce(DATE '{AS_OF}' < retry_after, false)) AS should_retry
    FROM b_loan l LEFT JOIN (SELECT * FROM b_clip WHERE stage <> 'exported') c ON l.wo_number = c.wo_number LEFT JOIN b_track t ON l.wo_number = t.wo_number""",
)(lambda l, c, t: J.should_retry(l, c.filter("stage <> 'exported'"), t, AS_OF))
