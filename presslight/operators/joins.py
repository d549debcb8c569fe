"""Look-ups, substring and semantic matches, merges (JN)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clips_dashboard(clips: DataFrame, runs: DataFrame) -> DataFrame:
    return clips.join(runs, "run_id", "left").orderBy(F.desc_nulls_last("processed_date"), "wo_number")


def oem_vs_media(clips: DataFrame, oem: DataFrame) -> DataFrame:
    """Clips with the intended message of their make, model and publication year."""
    return clips.withColumn("year", F.year("published_date")).join(oem, ["make", "model", "year"])


def prefix_join(clips: DataFrame, oem: DataFrame) -> DataFrame:
    """Clips whose model begins with the intended model, within the make ("CX-5" also meets "CX-50"). Different models meet by each of their prefixes."""
    models = clips.select("make", "model").distinct()
    prefixes = F.transform(F.sequence(F.lit(0), F.length("model")), lambda n: F.substring(F.col("model"), F.lit(1), n))
    begun = models.withColumn("oem_model", F.explode(prefixes)).join(oem.select("make", F.col("model").alias("oem_model")), ["make", "oem_model"])
    return clips.join(begun, ["make", "model"])


def _name(col: str) -> Column:
    return F.initcap(F.regexp_replace(F.trim(F.col(col)), r"\s+", " "))


def contact_to_person(df: DataFrame, outlets: DataFrame, keep: str = "first") -> DataFrame:
    """person_id by name where the row has none; of several ids for a name the smallest (first) or largest (last) counts."""
    pick = F.min if keep == "first" else F.max
    names = outlets.withColumn("_name", _name("reporter_name")).groupBy("_name").agg(pick("person_id").alias("_found"))
    return df.withColumn("_name", _name("contact")).join(names, "_name", "left").withColumn("person_id", F.coalesce("person_id", "_found")).drop("_name", "_found")


def url_outlet_join(urls: DataFrame, outlets: DataFrame) -> DataFrame:
    """Each person's URLs with those of their outlets whose domain is the URL's or above it: the host and what follows each of its dots meet the outlets' hosts."""
    host = lambda c: F.regexp_replace(F.lower(F.try_parse_url(F.col(c), F.lit("HOST"))), r"www\.", "")
    o = outlets.select("person_id", "outlet_id", "outlet_name", host("outlet_url").alias("_domain"))
    parts = F.split(host("url"), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return urls.withColumn("_domain", F.explode(above)).join(o, ["person_id", "_domain"]).drop("_domain")


def match_outlet(clips: DataFrame, outlets: DataFrame) -> DataFrame:
    """The person's outlet named as the affiliation, else the first (by id) whose name the affiliation holds, else none. Each affiliation of a person is matched once."""
    o = outlets.select("person_id", "outlet_id", "outlet_name")
    named = clips.select("person_id", "affiliation").distinct()
    rank = F.when(F.lower("outlet_name") == F.lower("affiliation"), 1).when(F.contains(F.lower("affiliation"), F.lower("outlet_name")), 2)
    best = named.join(o, "person_id").withColumn("_rank", rank).filter("_rank IS NOT NULL").groupBy("person_id", "affiliation").agg(F.min_by("outlet_name", F.struct("_rank", "outlet_id")).alias("matched_outlet"))
    return clips.join(best, ["person_id", "affiliation"], "left")


def _touch(a: str, b: str) -> Column:
    return F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a))


def substring_all_matches(left: DataFrame, right: DataFrame, k: Sequence[str], lcol: str, rcol: str) -> DataFrame:
    """Pairs of distinct non-empty labels within a key of which one holds the other; lower-cased."""
    a = left.select(*k, F.lower(F.trim(F.col(lcol))).alias(lcol)).filter(F.col(lcol) != "").distinct()
    b = right.select(*k, F.lower(F.trim(F.col(rcol))).alias(rcol)).filter(F.col(rcol) != "").distinct()
    return a.join(b, list(k)).filter(_touch(lcol, rcol))


def substring_first_match(left: DataFrame, right: DataFrame, k: Sequence[str], lcol: str, rcol: str, pos: str | None = None) -> DataFrame:
    """Each left label with its first right label, by the column pos of right (or in their own order), or null. Labels are matched once, not once per row."""
    pairs = substring_all_matches(left, right, k, lcol, rcol)
    if pos is None:
        found = pairs.groupBy(*k, lcol).agg(F.min(rcol).alias(rcol))
    else:
        places = right.groupBy(*k, F.lower(F.trim(F.col(rcol))).alias(rcol)).agg(F.min(pos).alias("_pos"))
        found = pairs.join(places, [*k, rcol]).groupBy(*k, lcol).agg(F.min_by(rcol, F.struct("_pos", rcol)).alias(rcol))
    return left.withColumn(lcol, F.lower(F.trim(F.col(lcol)))).join(found, [*k, lcol], "left")


def semantic_match(left: DataFrame, right: DataFrame, synonyms: DataFrame, k: Sequence[str], lcol: str, rcol: str) -> DataFrame:
    """Distinct label pairs of a key that share a synonym group or of which one holds the other. synonyms(group, term)."""
    a = left.select(*k, F.lower(F.col(lcol)).alias(lcol)).filter(F.col(lcol) != "").distinct()
    b = right.select(*k, F.lower(F.col(rcol)).alias(rcol)).filter(F.col(rcol) != "").distinct()
    # Groups are found for each different label, and labels meet by key and group.
    grouped = lambda df, c: df.join(df.select(c).distinct().join(synonyms, F.contains(F.col(c), F.col("term"))).select(c, "group").distinct(), c)
    by_group = grouped(a, lcol).join(grouped(b, rcol), [*k, "group"]).select(*k, lcol, rcol)
    return by_group.unionByName(a.join(b, list(k)).filter(_touch(lcol, rcol)).select(*k, lcol, rcol)).distinct()


def keep_keys(df: DataFrame, keys: DataFrame, k: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*k).distinct(), list(k), "left_semi")


def not_mentioned(intended: DataFrame, mentioned: DataFrame, k: Sequence[str], lcol: str, rcol: str) -> DataFrame:
    """Intended labels that no mention of the key touches."""
    touched = substring_all_matches(mentioned, intended, k, rcol, lcol).select(*k, lcol).distinct()
    return intended.withColumn(lcol, F.lower(F.col(lcol))).distinct().join(touched, [*k, lcol], "left_anti")


def merge_by_key(base: DataFrame, updates: DataFrame, k: Sequence[str], counters: Sequence[str] = ()) -> DataFrame:
    """Upsert: non-null values of updates win, new keys are added, counters add up. Keys are unique on both sides."""
    cols = [c for c in base.columns if c not in k]
    new = updates.select(*k, *(F.col(c).alias(f"_new_{c}") for c in updates.columns if c not in k))
    out = base.join(new, list(k), "full_outer")
    value = lambda c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_new_{c}"), F.lit(0)) if c in counters else F.coalesce(f"_new_{c}", c)
    return out.select(*k, *(value(c).alias(c) if c in updates.columns else F.col(c) for c in cols))


def patch_columns(base: DataFrame, patch: DataFrame, k: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The outcome of each patch row (invalid, not_found, no_change, updated) and the values that result."""
    old = base.select(*k, F.lit(True).alias("_found"), *(F.col(c).alias(f"_old_{c}") for c in cols))
    changed = F.lit(False)
    for c in cols:
        changed = changed | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_old_{c}")))
    blank = F.lit(False)
    for c in k:
        blank = blank | F.col(c).isNull()
    outcome = F.when(blank, "invalid").when(F.col("_found").isNull(), "not_found").when(~changed, "no_change").otherwise("updated")
    out = patch.join(old, list(k), "left").withColumn("outcome", outcome)
    return out.select(*k, "outcome", *(F.coalesce(c, f"_old_{c}").alias(c) for c in cols))


def backfill(df: DataFrame, source: DataFrame, k: Sequence[str], cols: Sequence[str], order: str, keep: str = "last") -> DataFrame:
    """Columns from a source by key where it has them; of several source rows the last (or first) by order counts."""
    pick = F.max_by if keep == "last" else F.min_by
    new = source.groupBy(*k).agg(*(pick(c, order).alias(f"_new_{c}") for c in cols))
    out = df.join(new, list(k), "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns))


def with_retry_status(clips: DataFrame, tracking: DataFrame, as_of) -> DataFrame:
    t = tracking.select("wo_number", "retry_after", "attempt_count")
    status = F.when(F.lit(as_of).cast("date") < F.col("retry_after"), "in_cooldown").otherwise("ready")
    return clips.join(t, "wo_number", "left").withColumn("retry_status", status)


def error_log(logs: DataFrame, workers: DataFrame, as_of, interval: str = "1 hour", n: int = 20) -> DataFrame:
    """Latest errors with their worker's row."""
    late = logs.filter(F.col("level").isin("ERROR", "CRITICAL") & (F.col("ts") > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {interval}")))
    return late.join(workers, "worker_id").orderBy(F.desc("ts"), "event_id").limit(n)


def repoint_duplicates(clips: DataFrame, runs: DataFrame) -> DataFrame:
    """Clips with the run kept of each group of runs of one name and minute in place of their own."""
    from .windows import rank_duplicate_jobs

    ranked = rank_duplicate_jobs(runs).select("run_id", "run_name", F.date_trunc("minute", "start_time").alias("_minute"), "rn")
    kept = ranked.filter("rn = 1").select("run_name", "_minute", F.col("run_id").alias("keep_id"))
    moves = ranked.filter("rn > 1").join(kept, ["run_name", "_minute"]).select("run_id", "keep_id")
    return clips.join(moves, "run_id", "left").withColumn("kept_run_id", F.coalesce("keep_id", "run_id")).drop("keep_id")


def match_sections(records: DataFrame, sections: DataFrame) -> DataFrame:
    """Records and sections of a URL that are equal or contain one another; the others as unmatched records and bonus sections."""
    r, s = records.select("url", F.lower("model").alias("model")).distinct(), sections.select("url", F.lower("section").alias("section")).distinct()
    pairs = r.join(s, "url").filter(_touch("model", "section"))
    first = pairs.groupBy("url", "model").agg(F.min(F.struct((F.col("model") != F.col("section")).alias("o"), "section"))["section"].alias("section")).withColumn("match", F.lit("matched"))
    lone = r.join(pairs, ["url", "model"], "left_anti").select("url", "model", F.lit(None).cast("string").alias("section"), F.lit("unmatched").alias("match"))
    bonus = s.join(pairs, ["url", "section"], "left_anti").select("url", F.lit(None).cast("string").alias("model"), "section", F.lit("bonus").alias("match"))
    return first.unionByName(lone).unionByName(bonus)


def should_retry(loans: DataFrame, clips: DataFrame, tracking: DataFrame, as_of) -> DataFrame:
    """Whether to try a work order: not with a final clip, not when found, not in cooldown; else yes, also when never tried."""
    c = clips.select("wo_number", F.col("status").alias("clip_status"))
    t = tracking.select("wo_number", F.col("status").alias("track_status"), "retry_after")
    retry = (
        F.when(F.col("clip_status").isin("approved", "pending_review", "rejected"), False)
        .when(F.col("track_status") == "found", False)
        .when(F.lit(as_of).cast("date") < F.col("retry_after"), False)
        .otherwise(True)
    )
    return loans.select("wo_number").join(c, "wo_number", "left").join(t, "wo_number", "left").withColumn("should_retry", retry)
