"""Filters over clips, loans, runs and logs (PF)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip_queue(clips: DataFrame, status: str, stages: Sequence[str] | None = None, run_id: str | None = None, since=None, limit: int | None = None) -> DataFrame:
    """Clips of a status (and stages, run, start), newest first, ties by wo_number."""
    out = clips.filter(F.col("status") == status)
    if stages:
        out = out.filter(F.col("stage").isin(*stages))
    if run_id is not None:
        out = out.filter(F.col("run_id") == run_id)
    if since is not None:
        out = out.filter(F.col("processed_date") >= F.lit(since).cast("date"))
    out = out.orderBy(F.desc_nulls_last("processed_date"), "wo_number")
    return out if limit is None else out.limit(limit)


def _chosen(col: str, value: str | None) -> Column:
    return F.lit(True) if value is None or value.startswith("All ") else F.col(col) == value


def filter_loans(loans: DataFrame, office=None, make=None, model=None, reporter=None, wo_list: str | None = None, activity_list: str | None = None, date_from=None, date_to=None) -> DataFrame:
    """The loan panel: None or "All ..." means no filter; lists are comma-separated text; a null start date fails a date range."""
    out = loans.filter(_chosen("office", office))
    for col, value in (("make", make), ("model", model), ("contact", reporter)):
        if value is not None:
            out = out.filter(_chosen(col, value))
    for col, text in (("wo_number", wo_list), ("activity_id", activity_list)):
        wanted = [x.strip() for x in (text or "").split(",") if x.strip()]
        if wanted:
            out = out.filter(F.col(col).cast("string").isin(*wanted))
    if date_from is not None:
        out = out.filter(F.col("start_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        out = out.filter(F.col("start_date") <= F.lit(date_to).cast("date"))
    return out


def filter_by_reporter(loans: DataFrame, outlets: DataFrame, reporter: str) -> DataFrame:
    """Loans of the persons with a reporter name; ids compare as whole numbers in text."""
    ids = outlets.filter(F.col("reporter_name") == reporter).select(F.col("person_id").cast("bigint").cast("string").alias("_id")).distinct()
    return loans.join(ids, F.col("person_id").cast("bigint").cast("string") == F.col("_id"), "left_semi")


def failed_clips(clips: DataFrame, run_id=None, start=None, end=None, statuses=("no_content_found", "processing_failed")) -> DataFrame:
    """Failed clips with few columns; the end date counts in full."""
    out = clips.filter(F.col("status").isin(*statuses))
    if run_id is not None:
        out = out.filter(F.col("run_id") == run_id)
    if start is not None:
        out = out.filter(F.col("processed_date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("processed_date") < F.date_add(F.lit(end).cast("date"), 1))
    return out.select("wo_number", "run_id", "contact", "make", "model", "processed_date", "status")


def export_query(clips: DataFrame, start, end, status=None, stage=None, min_relevance=None, sentiment=None, offices=None) -> DataFrame:
    """Clips processed from start to end, with optional filters. POS, NEU, NEG stand for the stored sentiments."""
    out = clips.filter(F.col("processed_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    for col, value in (("status", status), ("stage", stage), ("sentiment", {"POS": "positive", "NEU": "neutral", "NEG": "negative"}.get(sentiment, sentiment))):
        if value is not None:
            out = out.filter(F.col(col) == value)
    if min_relevance is not None:
        out = out.filter(F.col("relevance") >= min_relevance)
    return out.filter(F.col("office").isin(*offices)) if offices else out


def search_clips(clips: DataFrame, text: str, cols: Sequence[str], make=None, sentiment=None, limit: int = 200) -> DataFrame:
    """Clips with text in one of the columns, whatever its case; newest first."""
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False)) for c in cols))
    out = clips.filter(hit & F.col("published_date").isNotNull())
    if make is not None:
        out = out.filter(F.col("make") == make)
    if sentiment is not None:
        out = out.filter(F.col("sentiment") == sentiment)
    return out.orderBy(F.desc("published_date"), "wo_number").limit(limit)


def needing_sentiment(clips: DataFrame, run_ids: Sequence[str] | None = None) -> DataFrame:
    out = clips.filter((F.col("status") == "approved") & F.col("analysed").isNull())
    return out if run_ids is None else out.filter(F.col("run_id").isin(*run_ids))


def analysis_candidates(clips: DataFrame, status: str, mode: str = "only_missing", limit: int | None = None) -> DataFrame:
    """only_missing: never analysed; outdated: version null or not v2; force: all. Newest first."""
    keep = {"only_missing": F.col("analysed").isNull(), "outdated": F.col("version").isNull() | (F.col("version") != "v2"), "force": F.lit(True)}[mode]
    out = clips.filter((F.col("status") == status) & keep).orderBy(F.desc_nulls_last("processed_date"), "wo_number")
    return out if limit is None else out.limit(limit)


def reprocess_candidates(clips: DataFrame, make=None, model=None, limit: int | None = None) -> DataFrame:
    """Approved, analysed clips of version v1 or none."""
    out = clips.filter((F.col("status") == "approved") & F.col("analysed").isNotNull() & (F.col("version").isNull() | (F.col("version") == "v1")))
    for col, value in (("make", make), ("model", model)):
        if value is not None:
            out = out.filter(F.col(col) == value)
    out = out.orderBy(F.desc("analysed"), "wo_number")
    return out if limit is None else out.limit(limit)


def reprocess_status(clips: DataFrame) -> DataFrame:
    """Label and flag of each clip by analysis date, enhanced document and version."""
    label = (
        F.when(F.col("analysed").isNull(), "Never Analyzed")
        .when(F.col("sentiment").isNull(), "Missing Enhanced")
        .when(F.col("version").isNull() | (F.col("version") == "v1"), "Old Version")
        .when(F.col("version") == "v2", "Current")
        .otherwise("Unknown")
    )
    return clips.withColumn("label", label).withColumn("needs_reprocessing", ~F.col("label").isin("Current", "Unknown"))


def recent(df: DataFrame, ts: str, interval: str, as_of) -> DataFrame:
    """Rows later than as_of less an interval such as "4 hours"."""
    return df.filter(F.col(ts) > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {interval}"))


def bad_features(features: DataFrame, col: str = "feature") -> DataFrame:
    """Features that look like extraction errors, with the reasons."""
    c = F.trim(F.col(col))
    reasons = F.array_compact(
        F.array(
            F.when(F.length(c) < 4, "too_short"),
            F.when(c.rlike(r"^[0-9]+$"), "digits_only"),
            F.when(c.rlike(r"[^A-Za-z0-9 \-]"), "special_characters"),
            F.when(F.lower(c).rlike(r"\b(mm|cm|kg|lb|mph|hp)$"), "unit_suffix"),
        )
    )
    return features.withColumn("reasons", F.array_join(reasons, ",")).filter(F.col("reasons") != "")


def bad_reference_rows(oem: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows whose make and model aren't expected, or whose year differs from the expected one."""
    known = expected.select("make", "model", F.col("year").alias("_year"))
    reason = F.when(F.col("_year").isNull(), "not_expected").when(F.col("year") != F.col("_year"), "wrong_year")
    return oem.join(known, ["make", "model"], "left").withColumn("reason", reason).filter("reason IS NOT NULL").drop("_year")


def validate_export(df: DataFrame, required: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """Rows with the errors found in them, comma-separated, empty when valid."""
    errors = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"missing {c}") for c in required]
    errors += [F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull(), f"not a number {c}") for c in numeric]
    return df.withColumn("errors", F.array_join(F.array_compact(F.array(*errors)), ","))


def visible_rows(df: DataFrame, user: str, jobs: DataFrame | None = None) -> DataFrame:
    """A user's own rows; with jobs, rows (of logs) that belong to the user's jobs."""
    if jobs is None:
        return df.filter(F.col("created_by") == user)
    return df.join(jobs.filter(F.col("created_by") == user), "run_id", "left_semi")
