"""PF, WN, TK queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import queues as Q
from ...operators import windows as X
from ..bindings import AS_OF, EVENTS_AS_OF
from ..registry import query

CLIP = "wo_number, run_id, contact, make, model, status, stage, processed_date"
_clip = [c.strip() for c in CLIP.split(",")]

query("PF-01", "b_clip", sql=f"SELECT {CLIP} FROM b_clip WHERE status = 'approved' AND stage IN ('approved', 'found') ORDER BY processed_date DESC NULLS LAST, wo_number LIMIT 1000")(
    lambda c: Q.clip_queue(c, "approved", ["approved", "found"], limit=1000).select(_clip)
)
query("PF-02", "b_loan", sql="SELECT * FROM b_loan WHERE office = 'NATION_3' AND start_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")(
    lambda l: Q.filter_loans(l, office="NATION_3", reporter="All reporters", date_from="1996-01-01", date_to="1999-12-31")
)
query("PF-03", "b_loan", "b_outlet", sql="SELECT * FROM b_loan WHERE person_id IN (SELECT person_id FROM b_outlet WHERE reporter_name = 'Reporter NATION_5')")(
    lambda l, o: Q.filter_by_reporter(l, o, "Reporter NATION_5")
)
query("PF-04", "b_clip", sql="SELECT wo_number, run_id, contact, make, model, processed_date, status FROM b_clip WHERE status IN ('no_content_found', 'processing_failed') AND processed_date >= DATE '1997-01-01' AND processed_date < DATE '1998-01-01'")(
    lambda c: Q.failed_clips(c, start="1997-01-01", end="1997-12-31")
)
query("PF-05", "b_clip", sql=f"SELECT {CLIP}, relevance, sentiment FROM b_clip WHERE processed_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND status = 'approved' AND relevance >= 8 AND sentiment = 'positive'")(
    lambda c: Q.export_query(c, "1998-01-01", "1999-12-31", status="approved", min_relevance=8, sentiment="POS").select(*_clip, "relevance", "sentiment")
)
query("PF-06", "b_clip", sql=f"SELECT {CLIP} FROM b_clip WHERE published_date IS NOT NULL AND (lower(model) LIKE '%widget%' OR lower(contact) LIKE '%widget%') ORDER BY published_date DESC, wo_number LIMIT 200")(
    lambda c: Q.search_clips(c, "WIDGET", ["model", "contact"]).select(_clip)
)
query("PF-07", "b_clip", sql=f"SELECT {CLIP} FROM b_clip WHERE status = 'approved' AND analysed IS NULL AND run_id IN ('1996-01', '1997-05')")(
    lambda c: Q.needing_sentiment(c, ["1996-01", "1997-05"]).select(_clip)
)
query("PF-08", "b_clip", sql=f"SELECT {CLIP}, version FROM b_clip WHERE status = 'approved' AND (version IS NULL OR version <> 'v2') ORDER BY processed_date DESC NULLS LAST, wo_number LIMIT 500")(
    lambda c: Q.analysis_candidates(c, "approved", "outdated", 500).select(*_clip, "version")
)
query("PF-09", "b_clip", sql=f"SELECT {CLIP}, version FROM b_clip WHERE status = 'approved' AND analysed IS NOT NULL AND (version IS NULL OR version = 'v1') AND make = 'Brand#7'")(
    lambda c: Q.reprocess_candidates(c, make="Brand#7").select(*_clip, "version")
)
query(
    "PF-10", "b_clip",
    sql="""SELECT label, count(*) AS clips, sum(CASE WHEN label NOT IN ('Current', 'Unknown') THEN 1 ELSE 0 END)::BIGINT AS needs FROM (
    SELECT CASE WHEN analysed IS NULL THEN 'Never Analyzed' WHEN sentiment IS NULL THEN 'Missing Enhanced' WHEN version IS NULL OR version = 'v1' THEN 'Old Version'
    WHEN version = 'v2' THEN 'Current' ELSE 'Unknown' END AS label FROM b_clip) GROUP BY label""",
)(lambda c: Q.reprocess_status(c).groupBy("label").agg(F.count("*").alias("clips"), F.count_if("needs_reprocessing").alias("needs")))
query("PF-11", "b_event", sql=f"SELECT event_id, ts, level FROM b_event WHERE ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOURS")(
    lambda e: Q.recent(e, "ts", "24 hours", EVENTS_AS_OF).select("event_id", "ts", "level")
)
query(
    "PF-19", "part",
    sql=r"""SELECT * FROM (SELECT p_partkey, p_name AS feature, array_to_string(list_filter([CASE WHEN length(trim(p_name)) < 4 THEN 'too_short' END,
    CASE WHEN regexp_matches(trim(p_name), '^[0-9]+$') THEN 'digits_only' END, CASE WHEN regexp_matches(trim(p_name), '[^A-Za-z0-9 \-]') THEN 'special_characters' END,
    CASE WHEN regexp_matches(lower(trim(p_name)), '\b(mm|cm|kg|lb|mph|hp)$') THEN 'unit_suffix' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM (SELECT p_partkey, concat(p_size, CASE p_type WHEN 'ECONOMY' THEN ' mm' WHEN 'PROMO' THEN '#inch' WHEN 'SMALL' THEN ' speakers' ELSE '' END) AS p_name FROM part)) WHERE reasons <> ''""",
)(lambda p: Q.bad_features(p.select("p_partkey", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_type") == "ECONOMY", " mm").when(F.col("p_type") == "PROMO", "#inch").when(F.col("p_type") == "SMALL", " speakers").otherwise("")).alias("feature"))))
query(
    "PF-20", "part",
    sql="""SELECT p_partkey, p_brand AS make, p_name AS model, p_size AS year, CASE WHEN e.y IS NULL THEN 'not_expected' ELSE 'wrong_year' END AS reason
    FROM part LEFT JOIN (SELECT p_brand AS b, p_name AS n, max(p_size) AS y FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1, 2) e ON b = p_brand AND n = p_name WHERE e.y IS NULL OR e.y <> p_size""",
)(
    lambda p: Q.bad_reference_rows(
        p.select("p_partkey", F.col("p_brand").alias("make"), F.col("p_name").alias("model"), F.col("p_size").alias("year")),
        p.filter("p_type <> 'ECONOMY'").groupBy(F.col("p_brand").alias("make"), F.col("p_name").alias("model")).agg(F.max("p_size").alias("year")),
    )
)
query(
    "PF-21", "b_clip",
    sql="""SELECT wo_number, array_to_string(list_filter([CASE WHEN make IS NULL OR trim(make) = '' THEN 'missing make' END, CASE WHEN clip_url IS NULL OR trim(clip_url) = '' THEN 'missing clip_url' END,
    CASE WHEN run_id IS NOT NULL AND try_cast(run_id AS DOUBLE) IS NULL THEN 'not a number run_id' END], lambda x: x IS NOT NULL), ',') AS errors FROM b_clip""",
)(lambda c: Q.validate_export(c, ["make", "clip_url"], ["run_id"]).select("wo_number", "errors"))
query("PF-22", "b_clip", "b_run", sql="SELECT wo_number, c.run_id FROM b_clip c WHERE run_id IN (SELECT run_id FROM b_run WHERE created_by = 'user1')")(
    lambda c, r: Q.visible_rows(c.select("wo_number", "run_id"), "user1", r)
)

_BEST = "relevance DESC, published DESC, url_pos, part_id, outlet_id, price"
query("AG-10", "b_cand", sql=f"SELECT make, wo_number, relevance FROM (SELECT *, row_number() OVER (PARTITION BY make ORDER BY {_BEST.replace('url_pos', 'wo_number, url_pos')}) AS rn FROM b_cand) WHERE rn = 1")(
    lambda c: X.keep_best(c, ["make"], [F.desc("relevance"), F.desc("published"), F.asc("wo_number"), *X.best_order()[2:]]).select("make", "wo_number", "relevance")
)
query("WN-01", "b_run", sql="SELECT run_id, run_name, row_number() OVER (PARTITION BY run_name, date_trunc('minute', start_time) ORDER BY CASE run_status WHEN 'completed' THEN 1 WHEN 'running' THEN 2 ELSE 3 END, total_records DESC, run_id)::INTEGER AS rn FROM b_run")(
    lambda r: X.rank_duplicate_jobs(r).select("run_id", "run_name", "rn")
)
query(
    "WN-02", "b_event",
    sql="""SELECT worker_id, stopped_at, ts AS resumed_at, gap_minutes FROM (SELECT *, round((epoch_us(ts) - epoch_us(stopped_at)) / 60e6, 4) AS gap_minutes FROM (
    SELECT *, lag(ts) OVER (PARTITION BY worker_id ORDER BY ts, event_id) AS stopped_at FROM b_event)) WHERE gap_minutes > 5""",
)(lambda e: X.processing_gaps(e, ["worker_id"], "ts", 5))
query("WN-03", "b_clip", sql="SELECT status, count(*) AS clips, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM b_clip GROUP BY status")(
    lambda c: X.percent_of_total(c.groupBy("status").agg(F.count("*").alias("clips")), "clips").withColumn("percent", F.col("percent").cast("double"))
)
query(
    "WN-04", "b_cand",
    sql=f"""SELECT wo_number, url_pos, make, model, relevance, published, attempted, successful FROM (SELECT *, count(*) OVER (PARTITION BY wo_number) AS attempted,
    count(*) FILTER (relevance > 0) OVER (PARTITION BY wo_number) AS successful, row_number() OVER (PARTITION BY wo_number ORDER BY {_BEST}) AS rn FROM b_cand) WHERE rn = 1""",
)(lambda c: X.best_clip(c).select("wo_number", "url_pos", "make", "model", "relevance", "published", "attempted", "successful"))
query(
    "WN-05", "b_cand",
    sql="""SELECT wo_number, url_pos, part_id, price, CASE WHEN before IS NULL OR relevance > before THEN 'Best match' ELSE 'Lower relevance' END AS result FROM (
    SELECT *, max(relevance) OVER (PARTITION BY wo_number ORDER BY url_pos, part_id, outlet_id, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b_cand)""",
)(lambda c: X.running_best(c).select("wo_number", "url_pos", "part_id", "price", "result"))
query(
    "WN-06", "b_cand",
    sql="""SELECT wo_number, url_pos, title, title_score FROM (SELECT *, row_number() OVER (PARTITION BY wo_number ORDER BY title_score DESC, url_pos, part_id, outlet_id, price) AS rn FROM (
    SELECT *, CASE WHEN lower(title) = lower(model) THEN 100 WHEN contains(lower(title), lower(model)) THEN 50 WHEN contains(lower(title), lower(split_part(model, ' ', 1))) THEN 10 ELSE 0 END AS title_score
    FROM (SELECT *, CASE relevance % 3 WHEN 0 THEN model WHEN 1 THEN concat('Review: ', model) ELSE concat(make, ' ', split_part(model, ' ', 1)) END AS title FROM b_cand)) WHERE title_score > 0) WHERE rn = 1""",
)(
    lambda c: X.best_title_match(
        c.withColumn("title", F.when(F.col("relevance") % 3 == 0, F.col("model")).when(F.col("relevance") % 3 == 1, F.concat(F.lit("Review: "), "model")).otherwise(F.concat("make", F.lit(" "), F.split_part("model", F.lit(" "), F.lit(1)))))
    ).select("wo_number", "url_pos", "title", "title_score")
)
query("WN-07", "b_clip", "b_run", sql=f"SELECT {CLIP} FROM b_clip WHERE run_id = (SELECT run_id FROM b_run ORDER BY start_time DESC, run_id DESC LIMIT 1)")(
    lambda c, r: c.join(F.broadcast(X.latest_run(r)), "run_id", "left_semi").select(_clip)
)
query("WN-08", "b_event", sql="SELECT worker_id, event_id, ts, level FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY ts DESC, event_id DESC) AS rn FROM b_event) WHERE rn = 1")(
    lambda e: X.latest_by_key(e.select("worker_id", "event_id", "ts", "level"), ["worker_id"], "ts", "event_id")
)
query("WN-10", "b_intent", sql="SELECT make, feature, position, CASE WHEN position <= 3 THEN 'primary' ELSE 'secondary' END AS priority FROM (SELECT *, row_number() OVER (PARTITION BY make ORDER BY feature)::INTEGER AS position FROM b_intent) WHERE position <= 10")(
    lambda i: X.tag_priority(i, "make", "feature")
)
query("TK-01", "b_loan", sql="SELECT * FROM b_loan ORDER BY start_date, wo_number LIMIT 100 OFFSET 50")(lambda l: X.skip_limit(l, ["start_date", "wo_number"], 50, 100))
query("TK-03", "b_clip", sql=f"SELECT {CLIP} FROM b_clip ORDER BY processed_date DESC NULLS LAST, wo_number LIMIT 50")(lambda c: X.top_n(c, [F.desc_nulls_last("processed_date"), F.asc("wo_number")], 50).select(_clip))
query("TK-04", "b_clip", sql="SELECT wo_number, make, relevance FROM b_clip ORDER BY relevance DESC NULLS LAST, make NULLS LAST, wo_number LIMIT 300")(
    lambda c: X.sort_nulls_last(c, [("relevance", "desc"), ("make", "asc"), ("wo_number", "asc")]).limit(300).select("wo_number", "make", "relevance")
)
query("TK-05", "b_cand", sql="SELECT wo_number, url_pos, part_id, published, score FROM (SELECT *, row_number() OVER (PARTITION BY wo_number ORDER BY published DESC, url_pos, part_id, outlet_id, price) AS rn FROM (SELECT *, relevance * 10 AS score FROM b_cand) WHERE score >= 35) WHERE rn <= 2")(
    lambda c: X.newest_relevant(c.withColumn("score", F.col("relevance") * 10), 35, 2).select("wo_number", "url_pos", "part_id", "published", "score")
)
