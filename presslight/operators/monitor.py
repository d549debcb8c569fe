"""Run statistics, progress, throughput, reports (AG-01, 06-12, 24-38) and set operations (SO)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import duration_text, minutes_between


def _pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0)).cast("double")


def run_stats(runs: DataFrame, clips: DataFrame) -> DataFrame:
    """Each run's clips by status, with sentiment, mean relevance and success rate."""
    counts = clips.groupBy("run_id").agg(
        F.count("*").alias("clips"),
        *(F.count_if(F.col("status") == s).alias(s) for s in ("approved", "pending_review", "no_content_found")),
        F.count_if(F.col("analysed").isNotNull()).alias("with_sentiment"),
        F.round(F.avg("relevance"), 1).alias("avg_relevance"),
    )
    return runs.join(counts, "run_id", "left").withColumn("success_rate", _pct(F.col("successful_finds"), F.col("total_records")))


def status_share(clips: DataFrame, since) -> DataFrame:
    from .windows import percent_of_total

    return percent_of_total(clips.filter(F.col("processed_date") >= F.lit(since).cast("date")).groupBy("status").agg(F.count("*").alias("clips")), "clips").withColumn("percent", F.col("percent").cast("double"))


def batch_summary(clips: DataFrame, since, as_of) -> DataFrame:
    """Counts and times of the clips since a date, and minutes since the last."""
    return clips.filter(F.col("processed_date") >= F.lit(since).cast("date")).agg(
        F.count("*").alias("clips"), F.count_if(F.col("status") == "approved").alias("found"), F.count_if(F.col("status") == "no_content_found").alias("not_found"),
        F.min("processed_date").alias("first_date"), F.max("processed_date").alias("last_date"), minutes_between(F.max("processed_date"), F.lit(as_of)).alias("minutes_since"),
    )


def progress_by(clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    return clips.groupBy(*keys).agg(
        F.count("*").alias("clips"), F.count_if(F.col("status") == "approved").alias("found"), F.count_if(F.col("status") != "approved").alias("not_found"),
        F.count_distinct("wo_number").alias("work_orders"), F.max("processed_date").alias("last_date"),
    )


def throughput(events: DataFrame, unit: str = "minute") -> DataFrame:
    """Events per unit of time, with the distinct levels."""
    return events.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("slot")).agg(F.count("*").alias("events"), F.concat_ws(",", F.array_sort(F.collect_set("level"))).alias("levels"))


def throughput_summary(per_slot: DataFrame) -> DataFrame:
    return per_slot.agg(F.round(F.avg("events"), 4).alias("avg_events"), F.max("events").alias("max_events"), F.count("*").alias("active_slots"))


def duplicate_report(df: DataFrame, k: Sequence[str]) -> DataFrame:
    return df.groupBy(*k).agg(F.count("*").alias("rows")).filter("rows > 1")


def group_lists(df: DataFrame, k: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*k).agg(*(F.concat_ws(",", F.array_sort(F.collect_list(c))).alias(f"{c}_list") for c in cols))


def queue_metrics(clips: DataFrame, high: int = 8) -> DataFrame:
    return clips.agg(F.count("*").alias("clips"), F.round(F.avg("relevance"), 4).alias("avg_relevance"), F.count_distinct("contact").alias("contacts"), F.count_distinct("outlet_id").alias("outlets"), F.count_if(F.col("relevance") >= high).alias("high_quality"))


def rejection_metrics(issues: DataFrame) -> DataFrame:
    """The most frequent reason (ties by name), and counts by pattern and type."""
    by_reason = issues.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("reason").rlike("(?i)no content")).alias("no_content"), F.count_if(F.col("type") == "Skipped").alias("skipped"))
    return by_reason.agg(F.min_by("reason", F.struct(-F.col("n"), "reason")).alias("top_reason"), F.sum("n").alias("issues"), F.sum("no_content").alias("no_content"), F.sum("skipped").alias("skipped"))


def export_metrics(clips: DataFrame) -> DataFrame:
    by = clips.groupBy("sentiment").agg(F.count("*").alias("n"), F.sum("relevance").alias("s"), F.count("relevance").alias("r"), F.count_if(F.col("stage") == "exported").alias("e"))
    return by.agg(F.sum("n").alias("clips"), F.round(F.sum("s") / F.sum("r"), 4).alias("avg_relevance"), F.min_by("sentiment", F.when(F.col("sentiment").isNotNull(), F.struct(-F.col("n"), "sentiment"))).alias("top_sentiment"), F.sum("e").alias("exported"))


def executive_summary(clips: DataFrame) -> DataFrame:
    """Metrics as rows (metric, value)."""
    one = clips.agg(
        F.count("*").cast("double").alias("total"), F.count_if(F.col("status") == "approved").cast("double").alias("found"), F.count_if(F.col("status") == "no_content_found").cast("double").alias("not_found"),
        F.round(F.avg("relevance"), 2).alias("mean_relevance"), F.count_if(F.col("relevance") >= 8).cast("double").alias("high_quality"), F.count_if(F.col("sentiment") == "positive").cast("double").alias("positive"),
    ).withColumn("success_rate", _pct(F.col("found"), F.col("total")))
    return one.unpivot([], ["total", "found", "not_found", "success_rate", "mean_relevance", "high_quality", "positive"], "metric", "value")


def feed_profile(loans: DataFrame) -> DataFrame:
    return loans.agg(F.count("*").alias("rows"), F.count_distinct("office").alias("offices"), F.count_distinct("person_id").alias("persons"), F.concat_ws(",", F.array_sort(F.collect_set("office"))).alias("office_list"))


def batching_potential(requests: DataFrame, n: int = 10) -> DataFrame:
    """Contacts by how many requests one batch per vehicle would save: loans, vehicles, URLs, requests now and batched, saving, bucket."""
    by = requests.groupBy("contact").agg(F.count_distinct("wo_number").alias("loans"), F.count_distinct("make", "model").alias("vehicles"), F.count_distinct("url").alias("urls"), F.count("*").alias("requests_now"))
    bucket = F.when(F.col("vehicles") == 1, "1").when(F.col("vehicles") <= 5, "2-5").otherwise("6+")
    out = by.withColumns({"requests_batched": F.col("urls"), "saving": _pct(F.col("requests_now") - F.col("urls"), F.col("requests_now"), 2), "bucket": bucket})
    return out.orderBy(F.desc("loans"), "contact").limit(n)


def batching_totals(requests: DataFrame, n: int = 10) -> DataFrame:
    """What batching saves the n contacts with the most loans, by bucket and, in the row `all`, in all."""
    out = batching_potential(requests, n).groupingSets([["bucket"], []], "bucket").agg(
        F.grouping_id().alias("level"), F.count("*").alias("contacts"), *(F.sum(c).alias(c) for c in ("loans", "vehicles", "requests_now", "requests_batched")),
        _pct(F.sum(F.col("requests_now") - F.col("requests_batched")), F.sum("requests_now"), 2).alias("saving"),
    )
    return out.select(F.when(F.col("level") == 1, "all").otherwise(F.col("bucket")).alias("bucket"), "contacts", "loans", "vehicles", "requests_now", "requests_batched", "saving")


def job_history(runs: DataFrame) -> DataFrame:
    """Each run's skipped count, duration and success rate."""
    days = F.datediff("end_time", "start_time").cast("long")
    return runs.select(
        "run_id", "run_status", "total_records", "successful_finds", "failed_attempts",
        F.greatest(F.lit(0), F.col("total_records") - F.col("successful_finds") - F.col("failed_attempts")).alias("skipped"), days.alias("days"), _pct(F.col("successful_finds"), F.col("total_records")).alias("success_rate"),
    )


def job_durations(runs: DataFrame) -> DataFrame:
    """Each run's counts, its errors (its own count, else the failed attempts), duration as text and user; null counts are 0, a null user is System."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    seconds = F.unix_timestamp("end_time") - F.unix_timestamp("start_time")
    duration = F.when(F.col("start_time").isNotNull() & F.col("end_time").isNotNull(), duration_text(seconds)).when(F.col("run_status") == "running", "Running").when(F.col("run_status") == "queued", "Queued").otherwise("N/A")
    errors = F.coalesce("error_count", "failed_attempts") if "error_count" in runs.columns else F.col("failed_attempts")
    return runs.select(
        "run_id", "run_status", n("total_records").alias("processed"), n("successful_finds").alias("successful"), n("failed_attempts").alias("failed"),
        F.greatest(F.lit(0), n("total_records") - n("successful_finds") - n("failed_attempts")).alias("skipped"), n(errors).alias("errors"), duration.alias("duration"), F.coalesce("created_by", F.lit("System")).alias("user"),
    )


def job_totals(runs: DataFrame) -> DataFrame:
    """Jobs and distinct users by status and, in the row `all`, of all; the success rate is that of ended jobs."""
    ended = F.count_if(F.col("run_status").isin("completed", "failed"))
    out = runs.groupingSets([["run_status"], []], "run_status").agg(
        F.grouping_id().alias("level"), F.count("*").alias("jobs"), F.count_distinct(F.coalesce("created_by", F.lit("System"))).alias("users"), _pct(F.count_if(F.col("run_status") == "completed"), ended).alias("success_rate")
    )
    return out.select(F.when(F.col("level") == 1, "all").otherwise(F.col("run_status")).alias("run_status"), "jobs", "users", "success_rate")


def post_breakdown(posts: DataFrame) -> DataFrame:
    """Posts, sums and means by platform, by creator and in all, from one aggregation: level, name, posts, impressions, engagements, means and share of all posts in percent."""
    name = lambda c: F.coalesce(c, F.lit("Unknown")).alias(c)
    metrics = ("impressions", "engagements")
    filled = posts.select(name("platform"), name("creator"), *(F.coalesce(m, F.lit(0)).alias(m) for m in metrics))
    out = filled.groupingSets([["platform"], ["creator"], []], "platform", "creator").agg(
        F.grouping_id().alias("g"), F.count("*").alias("posts"), *(F.sum(m).alias(m) for m in metrics), *(F.round(F.avg(m), 4).alias(f"mean_{m}") for m in metrics)
    )
    level = F.when(F.col("g") == 1, "platform").when(F.col("g") == 2, "creator").otherwise("all")
    whole = posts.agg(F.count("*").alias("_all"))  # one row
    return out.join(F.broadcast(whole)).select(level.alias("level"), F.coalesce("platform", "creator", F.lit("")).alias("name"), "posts", *metrics, *(f"mean_{m}" for m in metrics), _pct(F.col("posts"), F.col("_all"), 2).alias("share"))


def post_summary(posts: DataFrame, n: int = 10) -> DataFrame:
    """Top creators with their share of all impressions."""
    by = posts.groupBy("creator").agg(F.count("*").alias("posts"), F.sum("impressions").alias("impressions"), F.avg("impressions").alias("mean"))
    whole = posts.agg(F.sum("impressions").alias("_all"))  # one row
    share = F.round(100.0 * F.col("impressions") / F.col("_all"), 4).cast("double")
    return by.join(F.broadcast(whole)).withColumn("share", share).drop("_all").withColumn("mean", F.round("mean", 4)).orderBy(F.desc("posts"), "creator").limit(n)


def post_totals(posts: DataFrame) -> DataFrame:
    """Posts, sums of their metrics, and means a post, in one row."""
    metrics = ("impressions", "engagements", "likes", "comments")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in metrics]
    return posts.agg(F.count("*").alias("posts"), *sums, *(F.coalesce(F.round(F.avg(F.coalesce(c, F.lit(0))), 4), F.lit(0.0)).alias(f"mean_{c}") for c in metrics[:2]))


def post_shares(posts: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """Posts of each platform or creator (by) and their share of all posts in percent, most first; the first n."""
    counts = posts.groupBy(F.coalesce(by, F.lit("Unknown")).alias(by)).agg(F.count("*").alias("posts"))
    out = counts.withColumn("share", _pct(F.col("posts"), F.sum("posts").over(W.partitionBy(F.lit(0))))).orderBy(F.desc("posts"), by)
    return out if n is None else out.limit(n)


def cache_stats(cache: DataFrame, as_of) -> DataFrame:
    """Valid and expired entries by domain."""
    valid = F.col("expires_at") > F.lit(as_of).cast("date")
    return cache.groupBy("domain").agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("expired"))


def attempt_success(attempts: DataFrame) -> DataFrame:
    """Success rate by attempt number, and whether it counts as early (3 or less)."""
    by = attempts.groupBy("attempt").agg(F.count("*").alias("tries"), F.count_if("ok").alias("successes"))
    return by.withColumn("rate", _pct(F.col("successes"), F.col("tries"), 2)).withColumn("phase", F.when(F.col("attempt") <= 3, "early").otherwise("late"))


def search_accuracy(results: DataFrame, share: float = 0.8) -> DataFrame:
    """How many results hold enough of their target's words, and how these go with relevance."""
    words = F.split(F.lower("target"), " ")
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(F.col("text")), w)))
    right = results.withColumn("correct", hits / F.size(words) >= share)
    return right.agg(F.count("*").alias("results"), F.count_if("correct").alias("correct"), F.count_if(F.col("correct") & (F.col("relevance") >= 8)).alias("high_correct"), F.count_if(~F.col("correct") & (F.col("relevance") >= 8)).alias("high_wrong"))


def cooldown_overview(tracking: DataFrame, as_of, n: int = 50) -> DataFrame:
    """Work orders in cooldown with days left, longest first."""
    left = F.datediff("retry_after", F.lit(as_of).cast("date"))
    return tracking.filter(F.lit(as_of).cast("date") < F.col("retry_after")).withColumn("days_left", left).orderBy(F.desc("days_left"), "wo_number").limit(n)


def cooldown_counts(tracking: DataFrame, clips: DataFrame, as_of) -> DataFrame:
    """Work orders in cooldown and clips that failed, in one row."""
    waiting = tracking.agg(F.count_if(F.col("retry_after") > F.lit(as_of).cast("date")).alias("in_cooldown"))
    failed = clips.agg(F.count_if(F.col("status").isin("no_content_found", "processing_failed")).alias("failed_clips"))
    return waiting.join(F.broadcast(failed))  # a row each


def latest_failures(clips: DataFrame, n: int = 50) -> DataFrame:
    """The last n clips that failed, newest first."""
    return clips.filter(F.col("status").isin("no_content_found", "processing_failed")).orderBy(F.desc_nulls_last("processed_date"), "wo_number").limit(n)


def group_by_url(records: DataFrame) -> DataFrame:
    return records.groupBy("url").agg(F.count("*").alias("records"), F.concat_ws(",", F.array_sort(F.collect_set("model"))).alias("models"))


def nest_outlets(rows: DataFrame) -> DataFrame:
    """A row per person with its outlets as structs, ordered by id."""
    return rows.groupBy("person_id").agg(F.first("reporter_name").alias("reporter_name"), F.array_sort(F.collect_list(F.struct("outlet_id", "outlet_name", "outlet_url", "impressions"))).alias("outlets"))


def flatten_outlets(nested: DataFrame) -> DataFrame:
    return nested.select("person_id", "reporter_name", F.inline("outlets"))


def pending_by_outlet(clips: DataFrame) -> DataFrame:
    return clips.filter(F.col("status") == "pending_review").groupBy("outlet_id").agg(F.count("*").alias("pending")).orderBy(F.desc("pending"), "outlet_id")


def issue_log(failed: DataFrame, skipped: DataFrame, rejected: DataFrame) -> DataFrame:
    """Failed, skipped and rejected clips in one form: wo_number, reason, type, details, processed_date."""
    names = {"already_approved": "Already Approved", "already_pending_review": "Already in Bulk Review", "already_rejected": "Already User Rejected", "retry_cooldown": "In Retry Cooldown", "unknown": "Unknown Skip Reason"}
    named = F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("skip_reason")], F.col("skip_reason"))
    kind = F.when(F.col("status") == "no_content_found", "No Content Found").otherwise("Processing Failed")
    retry = F.when(F.col("retry_status") == "in_cooldown", F.concat(F.lit(" (Retry after "), F.col("retry_after").cast("string"), F.lit(")"))).otherwise("")
    a = failed.select("wo_number", F.concat(kind, retry).alias("reason"), kind.alias("type"), "processed_date")
    b = skipped.select("wo_number", F.concat(F.lit("Skipped: "), named).alias("reason"), F.lit("Skipped").alias("type"), F.lit("Skipped in current run").alias("details"), "processed_date")
    c = rejected.select("wo_number", F.lit("User Rejected Clip").alias("reason"), F.lit("Rejected Clip").alias("type"), F.col("clip_url").alias("details"), "processed_date")
    return a.unionByName(b, allowMissingColumns=True).unionByName(c)


def distinct_urls(*sources: DataFrame) -> DataFrame:
    out = sources[0].select("url")
    for s in sources[1:]:
        out = out.unionByName(s.select("url"))
    return out.filter(F.col("url").isNotNull()).distinct()


def first_nonempty_source(df: DataFrame, arrays: Sequence[str], out: str = "urls") -> DataFrame:
    """The first of several array columns that has elements."""
    return df.withColumn(out, F.coalesce(*(F.when(F.size(a) > 0, F.col(a)) for a in arrays), F.array().cast("array<string>")))


def set_difference(intended: DataFrame, observed: DataFrame, k: Sequence[str], col: str) -> DataFrame:
    """Arrays of what is intended but not observed, and of both."""
    a = intended.groupBy(*k).agg(F.collect_set(col).alias("_a"))
    b = observed.groupBy(*k).agg(F.collect_set(col).alias("_b"))
    empty = F.array().cast("array<string>")
    joined = a.join(b, list(k), "left").withColumn("_b", F.coalesce("_b", empty))
    return joined.select(*k, F.concat_ws(",", F.array_sort(F.array_except("_a", "_b"))).alias("missing"), F.concat_ws(",", F.array_sort(F.array_intersect("_a", "_b"))).alias("matched"))
