"""Attempts, stages, retention and stale jobs as table-to-table steps (ST)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import minutes_between
from .joins import should_retry

# Days until a result is tried again; others are free at once.
RETRY_DAYS = {"no_content": 4, "no_content_found": 4, "generic_content": 3, "crawl_failed": 1, "blocked_403": 2, "timeout": 1, "store_failed": 1}


def apply_attempts(tracking: DataFrame, attempts: DataFrame) -> DataFrame:
    """Tracking after attempts(wo_number, result, at): counts add up; the last attempt decides status and retry date."""
    last = attempts.groupBy("wo_number").agg(F.count("*").alias("_n"), F.max("at").alias("_at"), F.max_by("result", F.struct("at", "result")).alias("_result"))
    days = F.try_element_at(F.create_map(*(F.lit(x) for kv in RETRY_DAYS.items() for x in kv)), F.col("_result"))
    tried = F.col("_n").isNotNull()
    return tracking.join(last, "wo_number", "full_outer").select(
        "wo_number",
        F.when(tried, F.when(F.col("_result") == "success", "found").otherwise("searching")).otherwise(F.col("status")).alias("status"),
        F.coalesce("_at", "last_attempt_date").alias("last_attempt_date"),
        (F.coalesce("attempt_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("attempt_count"),
        F.when(tried, F.date_add("_at", days)).otherwise(F.col("retry_after")).alias("retry_after"),
    )


def skip_reasons(loans: DataFrame, clips: DataFrame, tracking: DataFrame, as_of) -> DataFrame:
    """Work orders not tried now, and why."""
    s = F.col("clip_status")
    reason = F.when(s.isin("approved", "pending_review", "rejected"), F.concat(F.lit("already_"), s)).when(s.isin("no_content_found", "processing_failed"), "retry_cooldown").otherwise("unknown")
    return should_retry(loans, clips, tracking, as_of).filter(~F.col("should_retry")).select("wo_number", reason.alias("skip_reason"))


def loan_outcomes(loans: DataFrame, best: DataFrame, threshold: int = 5) -> DataFrame:
    """Each loan as stored, failed (candidates below the threshold) or not_found."""
    b = best.select("wo_number", "relevance", "attempted")
    outcome = F.when(F.col("attempted").isNull(), "not_found").when(F.col("relevance") >= threshold, "stored").otherwise("failed")
    return loans.select("wo_number").join(b, "wo_number", "left").withColumn("outcome", outcome)


def set_stage(clips: DataFrame, keys: DataFrame, status=None, stage=None, null_cols: Sequence[str] = ()) -> DataFrame:
    """Clips with a new status or stage, and fields emptied, for the keys given."""
    hit = clips.join(keys.select("wo_number").distinct().withColumn("_hit", F.lit(True)), "wo_number", "left")
    new = {c: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c)) for c, v in (("status", status), ("stage", stage)) if v is not None}
    new |= {c: F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)) for c in null_cols}
    return hit.withColumns(new).drop("_hit").select(*clips.columns)


def apply_sentiment(clips: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Analysis results written to their clips: v2 with a classification, else v1; lists never null; stage sentiment_analyzed."""
    r = results.select("wo_number", F.col("classification").alias("_class"), F.coalesce("pros", F.array().cast("array<string>")).alias("_pros"), F.lit(True).alias("_hit"))
    hit = F.col("_hit")
    return clips.join(r, "wo_number", "left").withColumns({
        "version": F.when(hit, F.when(F.col("_class").isNotNull(), "v2").otherwise("v1")).otherwise(F.col("version")),
        "sentiment": F.when(hit, F.coalesce("_class", "sentiment")).otherwise(F.col("sentiment")),
        "analysed": F.when(hit, F.lit(as_of).cast("date")).otherwise(F.col("analysed")),
        "stage": F.when(hit, "sentiment_analyzed").otherwise(F.col("stage")),
        "pros": F.coalesce("_pros", F.array().cast("array<string>")),
    }).drop("_hit", "_class", "_pros")


def reset_cooldowns(tracking: DataFrame, mode: str, as_of=None, keys: DataFrame | None = None) -> DataFrame:
    """all: no cooldown anywhere; past: those over by as_of; selected: those of the keys."""
    if mode == "selected":
        hit = keys.select("wo_number").distinct().withColumn("_hit", F.lit(True))
        out = tracking.join(hit, "wo_number", "left")
        return out.withColumn("retry_after", F.when(~F.coalesce("_hit", F.lit(False)), F.col("retry_after"))).drop("_hit").select(*tracking.columns)
    clear = F.lit(True) if mode == "all" else F.col("retry_after") <= F.lit(as_of).cast("date")
    return tracking.withColumn("retry_after", F.when(~clear, F.col("retry_after")))


def split_by_age(df: DataFrame, ts: str, days: int, as_of) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) at a cut-off of some days before as_of; rows without a time are kept."""
    old = F.coalesce(F.col(ts) < F.date_sub(F.lit(as_of).cast("date"), days), F.lit(False))
    return df.filter(~old), df.filter(old)


def backfill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def stage_audit(clips: DataFrame) -> DataFrame:
    """Clips in the analysed stage without an analysis date, with the fields that are filled."""
    fields = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), c) for c in ("sentiment", "version", "relevance"))))
    return clips.filter((F.col("stage") == "sentiment_analyzed") & F.col("analysed").isNull()).select("wo_number", F.array_join(fields, ",").alias("filled"))


def _silent(as_of, minutes: int):
    return F.col("last_heartbeat") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))


def expire_stale(runs: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """Running jobs without a heartbeat for so many minutes become failed; was_stale tells which, and so how many."""
    stale = (F.col("run_status") == "running") & _silent(as_of, minutes)
    return runs.withColumns({"was_stale": F.coalesce(stale, F.lit(False)), "run_status": F.when(stale, "failed").otherwise(F.col("run_status"))})


def offline_workers(workers: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """Workers without a heartbeat for so many minutes get the status offline."""
    return workers.withColumn("status", F.when(_silent(as_of, minutes), "offline").otherwise(F.col("status")))


def active_processes(procs: DataFrame, as_of) -> DataFrame:
    """Running jobs with minutes so far, progress and per cent."""
    done = F.col("successful_finds") + F.col("failed_attempts")
    return procs.filter(F.col("run_status") == "running").select(
        "run_id", minutes_between(F.col("start_time"), F.lit(as_of)).alias("minutes_running"), F.concat(done.cast("string"), F.lit("/"), F.col("total_records").cast("string")).alias("progress"),
        F.round(F.try_divide(100.0 * done, F.nullif("total_records", F.lit(0))), 2).cast("double").alias("percent"),
    )


def split_oem_document(oem: DataFrame) -> dict[str, DataFrame]:
    """A document's child rows: features, attributes, drivers, each with its position from 1. What its entries leave out gets the defaults of a manual entry."""

    def rows(field: str) -> DataFrame:
        return oem.select("model_id", F.posexplode(field).alias("_p", "_x")).withColumn("position", F.col("_p") + 1)

    def value(field: str, name: str, default: str):
        there = name in oem.schema[field].dataType.elementType.fieldNames()
        return (F.coalesce(f"_x.{name}", F.lit(default)) if there else F.lit(default)).alias(name)

    features, drivers = "key_features_intended", "purchase_drivers_intended"
    return {
        "features": rows(features).select(
            "model_id", "position", F.col("_x.feature").alias("feature"), value(features, "category", ""), F.coalesce("_x.priority", F.when(F.col("position") <= 3, "primary").otherwise("secondary")).alias("priority"),
            value(features, "messaging", ""), value(features, "target_sentiment", "positive"),
        ),
        "attributes": rows("brand_attributes_intended").select("model_id", "position", F.col("_x").alias("attribute"), F.lit("core").alias("importance")),
        "drivers": rows(drivers).select("model_id", "position", F.col("_x.reason").alias("reason"), F.col("_x.priority").alias("priority"), value(drivers, "target_audience", "")),
    }
