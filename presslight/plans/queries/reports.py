"""AG (runs, progress, reports) and SO queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import joins as J
from ...operators import monitor as M
from ..bindings import AS_OF
from ..registry import query

_PCT = "CASE WHEN {1} > 0 THEN round(100.0 * {0} / {1}, {2}) ELSE 0 END::DOUBLE"
query(
    "AG-01", "b_run", "b_clip",
    sql=f"""SELECT r.run_id, total_records, clips, approved, pending_review, no_content_found, with_sentiment, avg_relevance, {_PCT.format('successful_finds', 'total_records', 1)} AS success_rate FROM b_run r LEFT JOIN (
    SELECT run_id, count(*) AS clips, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'pending_review') AS pending_review, count(*) FILTER (status = 'no_content_found') AS no_content_found,
    count(analysed) AS with_sentiment, round(avg(relevance), 1) AS avg_relevance FROM b_clip GROUP BY 1) c ON r.run_id = c.run_id""",
)(lambda r, c: M.run_stats(r, c).select("run_id", "total_records", "clips", "approved", "pending_review", "no_content_found", "with_sentiment", "avg_relevance", "success_rate"))
query("AG-06", "b_clip", sql="SELECT status, count(*) AS clips, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM b_clip WHERE processed_date >= DATE '1998-01-01' GROUP BY status")(lambda c: M.status_share(c, "1998-01-01"))
query("AG-07", "b_clip", sql=f"SELECT count(*) AS clips, count(*) FILTER (status = 'approved') AS found, count(*) FILTER (status = 'no_content_found') AS not_found, min(processed_date) AS first_date, max(processed_date) AS last_date, round((epoch(TIMESTAMP '{AS_OF}') - epoch(max(processed_date)::TIMESTAMP)) / 60.0, 2)::DOUBLE AS minutes_since FROM b_clip WHERE processed_date >= DATE '1999-01-01'")(
    lambda c: M.batch_summary(c, "1999-01-01", AS_OF)
)
query("AG-08", "b_clip", sql="SELECT processed_date, count(*) AS clips, count(*) FILTER (status = 'approved') AS found, count(*) FILTER (status <> 'approved') AS not_found, count(DISTINCT wo_number) AS work_orders, max(processed_date) AS last_date FROM b_clip GROUP BY processed_date")(
    lambda c: M.progress_by(c, ["processed_date"])
)
query("AG-09", "b_event", sql="SELECT date_trunc('minute', ts) AS slot, count(*) AS events, string_agg(DISTINCT level, ',' ORDER BY level) AS levels FROM b_event GROUP BY 1")(M.throughput)
query("AG-09b", "b_event", sql="SELECT round(avg(n), 4) AS avg_events, max(n) AS max_events, count(*) AS active_slots FROM (SELECT count(*) AS n FROM b_event GROUP BY date_trunc('hour', ts))")(lambda e: M.throughput_summary(M.throughput(e, "hour")))
query("AG-11", "b_cand", sql="SELECT wo_number, url_pos, count(*) AS rows FROM b_cand GROUP BY 1, 2 HAVING count(*) > 1")(lambda c: M.duplicate_report(c, ["wo_number", "url_pos"]))
query("AG-12", "b_run", sql="SELECT run_name, string_agg(run_status, ',' ORDER BY run_status) AS run_status_list, string_agg(created_by, ',' ORDER BY created_by) AS created_by_list FROM b_run GROUP BY 1")(
    lambda r: M.group_lists(r, ["run_name"], ["run_status", "created_by"])
)
query("AG-24", "b_clip", sql="SELECT count(*) AS clips, round(avg(relevance), 4) AS avg_relevance, count(DISTINCT contact) AS contacts, count(DISTINCT outlet_id) AS outlets, count(*) FILTER (relevance >= 8) AS high_quality FROM b_clip")(M.queue_metrics)

_FAILED = f"""SELECT c.wo_number, concat('No Content Found', CASE WHEN DATE '{AS_OF}' < retry_after THEN concat(' (Retry after ', CAST(retry_after AS STRING), ')') ELSE '' END) AS reason, 'No Content Found' AS type, NULL AS details, processed_date
    FROM b_clip c LEFT JOIN b_track t ON c.wo_number = t.wo_number WHERE c.status = 'no_content_found'"""
_ISSUES = f"""{_FAILED} UNION ALL SELECT wo_number, concat('Skipped: ', CASE status WHEN 'approved' THEN 'Already Approved' ELSE 'Already in Bulk Review' END), 'Skipped', 'Skipped in current run', processed_date FROM b_clip WHERE status <> 'no_content_found' AND stage = 'found'
    UNION ALL SELECT wo_number, 'User Rejected Clip', 'Rejected Clip', clip_url, processed_date FROM b_clip WHERE stage = 'rejected'"""


def _issues(c, t):
    skipped = c.filter("status <> 'no_content_found' AND stage = 'found'").withColumn("skip_reason", F.concat(F.lit("already_"), "status"))
    return M.issue_log(J.with_retry_status(c.filter("status = 'no_content_found'"), t, AS_OF), skipped, c.filter("stage = 'rejected'"))


query("SO-01", "b_clip", "b_track", sql=_ISSUES)(_issues)
query("AG-25", "b_clip", "b_track", sql=f"WITH i AS ({_ISSUES}) SELECT (SELECT reason FROM i GROUP BY 1 ORDER BY count(*) DESC, reason LIMIT 1) AS top_reason, count(*) AS issues, count(*) FILTER (regexp_matches(reason, '(?i)no content')) AS no_content, count(*) FILTER (type = 'Skipped') AS skipped FROM i")(
    lambda c, t: M.rejection_metrics(_issues(c, t))
)
query("AG-26", "b_clip", sql="SELECT count(*) AS clips, round(sum(relevance) / count(relevance), 4) AS avg_relevance, (SELECT sentiment FROM b_clip WHERE sentiment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, sentiment LIMIT 1) AS top_sentiment, count(*) FILTER (stage = 'exported') AS exported FROM b_clip")(M.export_metrics)
query(
    "AG-27", "b_clip",
    sql=f"""WITH o AS (SELECT count(*)::DOUBLE AS total, (count(*) FILTER (status = 'approved'))::DOUBLE AS found, (count(*) FILTER (status = 'no_content_found'))::DOUBLE AS not_found, round(avg(relevance), 2) AS mean_relevance,
    (count(*) FILTER (relevance >= 8))::DOUBLE AS high_quality, (count(*) FILTER (sentiment = 'positive'))::DOUBLE AS positive FROM b_clip), p AS (SELECT *, {_PCT.format('found', 'total', 1)} AS success_rate FROM o)
    SELECT metric, value FROM (UNPIVOT p ON total, found, not_found, success_rate, mean_relevance, high_quality, positive INTO NAME metric VALUE value)""",
)(M.executive_summary)
query("AG-28", "b_loan", sql="SELECT count(*) AS rows, count(DISTINCT office) AS offices, count(DISTINCT person_id) AS persons, string_agg(DISTINCT office, ',' ORDER BY office) AS office_list FROM b_loan")(M.feed_profile)
query(
    "AG-29", "b_cand", "b_loan",
    sql=f"""SELECT contact, count(DISTINCT c.wo_number) AS loans, count(DISTINCT (make, model)) AS vehicles, count(DISTINCT url) AS urls, count(*) AS requests_now, count(DISTINCT url) AS requests_batched, {_PCT.format('(count(*) - count(DISTINCT url))', 'count(*)', 2)} AS saving,
    CASE WHEN count(DISTINCT (make, model)) = 1 THEN '1' WHEN count(DISTINCT (make, model)) <= 5 THEN '2-5' ELSE '6+' END AS bucket FROM b_cand c JOIN b_loan l ON c.wo_number = l.wo_number GROUP BY contact ORDER BY loans DESC, contact LIMIT 10""",
)(lambda c, l: M.batching_potential(c.join(l.select("wo_number", "contact"), "wo_number")))
query("AG-30", "b_run", sql=f"SELECT run_id, run_status, total_records, successful_finds, failed_attempts, greatest(0, total_records - successful_finds - failed_attempts) AS skipped, date_diff('day', start_time, end_time) AS days, {_PCT.format('successful_finds', 'total_records', 1)} AS success_rate FROM b_run")(M.job_history)
query("AG-31", "b_event", sql="SELECT worker_id AS creator, count(*) AS posts, sum(event_id % 1000)::BIGINT AS impressions, round(avg(event_id % 1000), 4) AS mean, round(100.0 * sum(event_id % 1000) / (SELECT sum(event_id % 1000) FROM b_event), 4)::DOUBLE AS share FROM b_event GROUP BY 1 ORDER BY posts DESC, creator LIMIT 10")(
    lambda e: M.post_summary(e.select(F.col("worker_id").alias("creator"), (F.col("event_id") % 1000).alias("impressions")))
)
_JOBS = "count(*) AS jobs, count(DISTINCT created_by) AS users, " + _PCT.format("count(*) FILTER (run_status = 'completed')", "count(*) FILTER (run_status IN ('completed', 'failed'))", 1) + " AS success_rate"
query("AG-30b", "b_run", sql=f"SELECT run_status, {_JOBS} FROM b_run GROUP BY run_status UNION ALL SELECT 'all', {_JOBS} FROM b_run")(M.job_totals)
query("AG-30c", "b_run", sql="SELECT run_id, run_status, total_records AS processed, successful_finds AS successful, failed_attempts AS failed, greatest(0, total_records - successful_finds - failed_attempts) AS skipped, failed_attempts AS errors, CASE WHEN run_status = 'running' THEN 'Running' ELSE 'ended' END AS duration, created_by AS user FROM b_run")(
    lambda r: M.job_durations(r.withColumn("end_time", F.when(F.col("run_status") != "running", F.col("end_time")))).withColumn("duration", F.when(F.col("duration") == "Running", "Running").otherwise("ended"))
)
query(
    "AG-29b", "b_cand", "b_loan",
    sql=f"""WITH t AS (SELECT contact, count(DISTINCT c.wo_number) AS loans, count(DISTINCT (make, model)) AS vehicles, count(*) AS requests_now, count(DISTINCT url) AS requests_batched FROM b_cand c JOIN b_loan l ON c.wo_number = l.wo_number GROUP BY contact ORDER BY loans DESC, contact LIMIT 10),
    u AS (SELECT *, CASE WHEN vehicles = 1 THEN '1' WHEN vehicles <= 5 THEN '2-5' ELSE '6+' END AS bucket FROM t)
    SELECT coalesce(bucket, 'all') AS bucket, count(*) AS contacts, sum(loans)::BIGINT AS loans, sum(vehicles)::BIGINT AS vehicles, sum(requests_now)::BIGINT AS requests_now, sum(requests_batched)::BIGINT AS requests_batched, {_PCT.format('sum(requests_now - requests_batched)', 'sum(requests_now)', 2)} AS saving FROM u GROUP BY GROUPING SETS ((bucket), ())""",
)(lambda c, l: M.batching_totals(c.join(l.select("wo_number", "contact"), "wo_number")))
query(
    "AG-31b", "b_event",
    sql=f"""WITH p AS (SELECT CASE event_type WHEN 'view' THEN 'Unknown' ELSE event_type END AS platform, CAST(worker_id AS STRING) AS creator, event_id % 1000 AS impressions, event_id % 7 AS engagements FROM b_event)
    SELECT CASE WHEN platform IS NOT NULL THEN 'platform' WHEN creator IS NOT NULL THEN 'creator' ELSE 'all' END AS level, coalesce(platform, creator, '') AS name, count(*) AS posts, sum(impressions)::BIGINT AS impressions, sum(engagements)::BIGINT AS engagements,
    round(avg(impressions), 4) AS mean_impressions, round(avg(engagements), 4) AS mean_engagements, {_PCT.format('count(*)', '(SELECT count(*) FROM p)', 2)} AS share FROM p GROUP BY GROUPING SETS ((platform), (creator), ())""",
)(
    lambda e: M.post_breakdown(e.select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("platform"), F.col("worker_id").cast("string").alias("creator"), (F.col("event_id") % 1000).alias("impressions"), (F.col("event_id") % 7).alias("engagements")))
)
query("AG-35b", "b_track", "b_clip", sql=f"SELECT (SELECT count(*) FROM b_track WHERE retry_after > DATE '{AS_OF}') AS in_cooldown, (SELECT count(*) FROM b_clip WHERE status IN ('no_content_found', 'processing_failed')) AS failed_clips")(lambda t, c: M.cooldown_counts(t, c, AS_OF))
query("AG-35c", "b_clip", sql="SELECT wo_number, processed_date FROM b_clip WHERE status IN ('no_content_found', 'processing_failed') ORDER BY processed_date DESC NULLS LAST, wo_number LIMIT 50")(lambda c: M.latest_failures(c).select("wo_number", "processed_date"))
query("AG-32", "b_cand", sql=f"SELECT outlet_id AS domain, count(*) AS total, count(*) FILTER (published > DATE '{AS_OF}') AS valid, count(*) FILTER (published <= DATE '{AS_OF}') AS expired FROM b_cand GROUP BY 1")(
    lambda c: M.cache_stats(c.select(F.col("outlet_id").alias("domain"), F.col("published").alias("expires_at")), AS_OF)
)
query("AG-33", "b_cand", sql=f"SELECT url_pos AS attempt, count(*) AS tries, count(*) FILTER (relevance >= 8) AS successes, {_PCT.format('count(*) FILTER (relevance >= 8)', 'count(*)', 2)} AS rate, CASE WHEN url_pos <= 3 THEN 'early' ELSE 'late' END AS phase FROM b_cand GROUP BY 1")(
    lambda c: M.attempt_success(c.select(F.col("url_pos").alias("attempt"), (F.col("relevance") >= 8).alias("ok")))
)
query(
    "AG-34", "b_cand",
    sql="""SELECT count(*) AS results, count(*) FILTER (correct) AS correct, count(*) FILTER (correct AND relevance >= 8) AS high_correct, count(*) FILTER (NOT correct AND relevance >= 8) AS high_wrong FROM (
    SELECT relevance, len(list_filter(string_split(lower(model), ' '), lambda w: contains(lower(CASE WHEN url_pos % 2 = 0 THEN url ELSE trim END), w))) / len(string_split(lower(model), ' ')) >= 0.8 AS correct FROM b_cand)""",
)(lambda c: M.search_accuracy(c.select("relevance", F.col("model").alias("target"), F.when(F.col("url_pos") % 2 == 0, F.col("url")).otherwise(F.col("trim")).alias("text"))))
query("AG-35", "b_track", sql=f"SELECT wo_number, retry_after, date_diff('day', DATE '{AS_OF}', retry_after)::INTEGER AS days_left FROM b_track WHERE DATE '{AS_OF}' < retry_after ORDER BY days_left DESC, wo_number LIMIT 50")(
    lambda t: M.cooldown_overview(t, AS_OF).select("wo_number", "retry_after", "days_left")
)
query("AG-36", "b_cand", sql="SELECT url, count(*) AS records, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM b_cand GROUP BY 1")(M.group_by_url)
query("AG-37", "b_outlet", sql="SELECT person_id, reporter_name, outlet_id, outlet_name, outlet_url, impressions FROM b_outlet")(lambda o: M.flatten_outlets(M.nest_outlets(o)))
query("AG-38", "b_clip", sql="SELECT outlet_id, count(*) AS pending FROM b_clip WHERE status = 'pending_review' GROUP BY 1")(M.pending_by_outlet)
query("SO-02", "b_cand", "b_clip", sql="SELECT url FROM b_cand WHERE relevance > 8 UNION SELECT clip_url FROM b_clip WHERE clip_url IS NOT NULL")(lambda c, k: M.distinct_urls(c.filter("relevance > 8"), k.withColumnRenamed("clip_url", "url")))
query("SO-03", "b_cand", sql="SELECT wo_number, url_pos, part_id, price, CASE WHEN relevance > 7 THEN url WHEN relevance > 3 THEN model ELSE trim END AS urls FROM b_cand")(
    lambda c: M.first_nonempty_source(
        c.withColumns({"a": F.when(F.col("relevance") > 7, F.array("url")).otherwise(F.array().cast("array<string>")), "b": F.when(F.col("relevance") > 3, F.array("model")), "c": F.array("trim")}), ["a", "b", "c"]
    ).select("wo_number", "url_pos", "part_id", "price", F.concat_ws(",", "urls").alias("urls"))
)
query(
    "SO-04", "b_intent", "b_cand",
    sql="""WITH o AS (SELECT DISTINCT make, split_part(model, ' ', 2) AS feature FROM b_cand WHERE relevance = 10 AND price < 4000)
    SELECT i.make, coalesce(string_agg(i.feature, ',' ORDER BY i.feature) FILTER (o.feature IS NULL), '') AS missing, coalesce(string_agg(i.feature, ',' ORDER BY i.feature) FILTER (o.feature IS NOT NULL), '') AS matched FROM b_intent i LEFT JOIN o ON i.make = o.make AND i.feature = o.feature GROUP BY 1""",
)(lambda i, c: M.set_difference(i, c.filter("relevance = 10 AND price < 4000").select("make", F.split_part("model", F.lit(" "), F.lit(2)).alias("feature")), ["make"], "feature"))
