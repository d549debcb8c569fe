"""Ranking, gaps, running values, top-k and paging (WN, TK, AG-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_best(df: DataFrame, k: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order; give a unique last key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*k).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def best_order() -> list[Column]:
    return [F.desc_nulls_last("relevance"), F.coalesce(F.col("published"), F.lit("1970-01-01").cast("date")).desc(), F.asc("url_pos"), F.asc("part_id"), F.asc("outlet_id"), F.asc("price")]


def best_clip(candidates: DataFrame, threshold: int = 0) -> DataFrame:
    """The best candidate of each work order, with attempted and successful (relevance above threshold) counts."""
    all_ = W.partitionBy("wo_number")
    counted = candidates.withColumns({"attempted": F.count("*").over(all_), "successful": F.count_if(F.col("relevance") > threshold).over(all_)})
    return keep_best(counted, ["wo_number"], best_order())


def running_best(attempts: DataFrame) -> DataFrame:
    """Attempts in URL order with "Best match" where one exceeds all earlier ones."""
    order = W.partitionBy("wo_number").orderBy("url_pos", "part_id", "outlet_id", "price").rowsBetween(W.unboundedPreceding, -1)
    before = F.max("relevance").over(order)
    return attempts.withColumn("result", F.when(before.isNull() | (F.col("relevance") > before), "Best match").otherwise("Lower relevance"))


def rank_duplicate_jobs(runs: DataFrame) -> DataFrame:
    """Rank of jobs of one name that began in the same minute: completed, running, others; then the most records."""
    state = F.when(F.col("run_status") == "completed", 1).when(F.col("run_status") == "running", 2).otherwise(3)
    w = W.partitionBy("run_name", F.date_trunc("minute", "start_time")).orderBy(state, F.desc_nulls_last("total_records"), "run_id")
    return runs.withColumn("rn", F.row_number().over(w))


def processing_gaps(events: DataFrame, k: Sequence[str], ts: str, minutes: int = 5) -> DataFrame:
    """Pauses longer than some minutes within each key. The key keeps it off one task; a day or worker serves."""
    last = F.lag(ts).over(W.partitionBy(*k).orderBy(ts, "event_id"))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("stopped_at").cast("timestamp"))
    gaps = events.withColumn("stopped_at", last).withColumn("gap_minutes", F.round(seconds / 60e6, 4))
    return gaps.filter(F.col("gap_minutes") > minutes).select(*k, "stopped_at", F.col(ts).alias("resumed_at"), "gap_minutes")


def percent_of_total(df: DataFrame, value: str, digits: int = 2) -> DataFrame:
    """Each (already grouped) row's share of the total."""
    return df.withColumn("percent", F.round(100.0 * F.col(value) / F.sum(value).over(W.partitionBy(F.lit(0))), digits))


def best_title_match(videos: DataFrame) -> DataFrame:
    """First best video of each order: title equals the model 100, holds it 50, holds its first word 10."""
    score = F.when(F.lower("title") == F.lower("model"), 100).when(F.contains(F.lower("title"), F.lower("model")), 50).when(F.contains(F.lower("title"), F.lower(F.split_part("model", F.lit(" "), F.lit(1)))), 10).otherwise(0)
    return keep_best(videos.withColumn("title_score", score).filter("title_score > 0"), ["wo_number"], [F.desc("title_score"), F.asc("url_pos"), F.asc("part_id"), F.asc("outlet_id"), F.asc("price")])


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by("run_id", F.struct("start_time", "run_id")).alias("run_id"))


def latest_by_key(df: DataFrame, k: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Each key's latest row, through one aggregate."""
    others = [c for c in df.columns if c not in k]
    return df.groupBy(*k).agg(F.max_by(F.struct(*others), F.struct(ts, tie)).alias("_r")).select(*k, *(F.col(f"_r.{c}").alias(c) for c in others))


def tag_priority(features: DataFrame, k: str, pos: str, primary: int = 3, cap: int = 10) -> DataFrame:
    """First features primary, the others secondary, no more than cap for each key."""
    rn = F.row_number().over(W.partitionBy(k).orderBy(pos))
    return features.withColumn("position", rn).filter(F.col("position") <= cap).withColumn("priority", F.when(F.col("position") <= primary, "primary").otherwise("secondary"))


def skip_limit(df: DataFrame, ordinal: Sequence[str], skip: int, limit: int | None = None) -> DataFrame:
    """Rows after the first skip by ordinal, limit of them; skip counts for nothing where there are no more rows than it.

    One of two parts has rows: the ordered rows after skip, or, by a count in one row, all of them.
    """
    part = lambda x: x if limit is None else x.limit(limit)
    few = df.agg((F.count("*") <= skip).alias("_few")).filter("_few")
    whole = df.join(F.broadcast(few)).drop("_few")
    return part(df.orderBy(*ordinal).offset(skip)).union(part(whole.orderBy(*ordinal)))


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sort_nulls_last(df: DataFrame, specs: Sequence[tuple[str, str]]) -> DataFrame:
    """Sorted by (column, "asc" or "desc"), nulls last in each."""
    return df.orderBy(*(F.asc_nulls_last(c) if d == "asc" else F.desc_nulls_last(c) for c, d in specs))


def newest_relevant(videos: DataFrame, min_score: int = 35, n: int = 1) -> DataFrame:
    """The newest videos of each work order that score enough."""
    return keep_best(videos.filter(F.col("score") >= min_score), ["wo_number"], [F.desc_nulls_last("published"), F.asc("url_pos"), F.asc("part_id"), F.asc("outlet_id"), F.asc("price")], n)
