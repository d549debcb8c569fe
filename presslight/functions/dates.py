"""Dates of content (SF-20 to 26, 47, 49)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import ARCHIVE_MARKS, _any_in


# The first year that is not early, and marks of copies of pages.
FIRST_YEAR = 2022
COPY_MARKS = ["archive.org", "archive.is", "wayback", "cached", "/cache/", "webcache.googleusercontent"]


def _copied_or_early(url):
    years = F.regexp_extract_all(url, F.lit(r"/(20\d{2})/"), F.lit(1))
    return F.coalesce(F.exists(years, lambda y: y.cast("int") < FIRST_YEAR) | _any_in(F.lower(url), COPY_MARKS), F.lit(False))


def date_acceptance(df: DataFrame, as_of: str, before: int = 30, after: int = 180, max_age_days: int = 540) -> DataFrame:
    """accepted and reason for content(published, start_date, platform, url): future, age and loan window; undated content by platform and URL."""
    now = F.lit(as_of).cast("date")
    age = F.datediff(now, "published")
    year = F.try_element_at(F.regexp_extract_all("url", F.lit(r"/(20\d{2})/"), F.lit(1)), F.lit(1)).cast("int")
    old = F.coalesce((F.year(now) - year > 2) | _any_in(F.lower("url"), ARCHIVE_MARKS), F.lit(False))
    dated = (
        F.when(age < -7, "future").when(age > max_age_days, "too_old")
        .when(F.col("published") < F.date_sub("start_date", before), "before_window").when(F.col("published") > F.date_add("start_date", after), "after_window").otherwise("ok")
    )
    undated = F.when(F.col("platform").isin("youtube", "tiktok", "instagram"), F.when(_copied_or_early(F.col("url")), "old_url").otherwise("ok_undated")).when(F.col("platform").isin("web", "article"), F.when(old, "old_url").otherwise("undated")).otherwise("unknown_type")
    reason = F.when(F.col("published").isNotNull(), dated).otherwise(undated)
    return df.withColumn("reason", reason).withColumn("accepted", F.startswith("reason", F.lit("ok")))


# Full dates in the path of a URL, and years in it.
FULL_DATES = [r"/(\d{4})/(\d{1,2})/(\d{1,2})(?:/|$)", r"/(\d{4})-(\d{1,2})-(\d{1,2})", r"_(\d{4})(\d{2})(\d{2})"]
YEARS = [r"/(\d{4})-[^/]*/", r"/(\d{4})/\d{2}/", r"/(\d{4})/", r"(\d{4})-[a-zA-Z-]+"]


def date_from_url(url: Column, as_of: str) -> Column:
    """A full date in the path, else 1 January of a year in it from 2000 to that of as_of."""
    now = F.year(F.lit(as_of).cast("date"))
    dates = []
    for p in FULL_DATES:
        parts = [F.nullif(F.regexp_extract(url, p, k), F.lit("")) for k in (1, 2, 3)]
        dates.append(F.try_to_date(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd"))
    years = []
    for p in YEARS:
        y = F.try_element_at(F.filter(F.regexp_extract_all(url, F.lit(p), F.lit(1)), lambda m: m.cast("int").between(2000, now)), F.lit(1))
        years.append(F.make_date(y.cast("int"), F.lit(1), F.lit(1)))
    return F.coalesce(*dates, *years)


# Formats of dates in pages and feeds.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy", "yyyy/MM/dd")


def parse_date(col: Column, formats: Sequence[str] = FORMATS) -> Column:
    """The first format that fits, after a leading word such as "Published:"; null without a full date."""
    text = F.trim(F.regexp_replace(col, r"(?i)^\s*(published|updated|posted|date)( on)?\s*:?\s*", ""))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats))


# Seconds of the units, a month as 30 days and a year as 365.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def parse_relative_date(col: Column, as_of: str) -> Column:
    """ "3 days ago", "a week ago", "yesterday" as a timestamp before as_of; today and yesterday mean noon."""
    text, now = F.lower(F.trim(col)), F.lit(as_of).cast("timestamp_ntz")
    units = "|".join(UNIT_SECONDS)
    number, unit = F.regexp_extract(text, rf"(\d+)\s*({units})s?\s*ago", 1), F.regexp_extract(text, rf"(\d+)\s*({units})s?\s*ago", 2)
    single = F.regexp_extract(text, rf"\b(a|an|one)\s*({units})\s*ago", 2)
    seconds = F.create_map(*(F.lit(x) for kv in UNIT_SECONDS.items() for x in kv))
    back = F.when(number != "", number.try_cast("long") * F.try_element_at(seconds, unit)).when(single != "", F.try_element_at(seconds, single).cast("long"))
    noon = F.date_trunc("day", now).cast("timestamp_ntz") + F.expr("interval 12 hours")
    special = F.when(F.contains(text, F.lit("yesterday")), noon - F.expr("interval 1 day")).when(F.contains(text, F.lit("today")), noon)
    return F.coalesce(now - F.make_dt_interval(secs=back.cast("decimal(18,6)")), special)


def duration_text(seconds: Column) -> Column:
    """2d 3h, 3h 5m, 5m 10s or 10s; null below zero."""
    s = seconds.cast("long")
    part = lambda unit: F.expr("cast(0 as bigint)") + F.floor(s / unit)
    return (
        F.when(s < 0, F.lit(None)).when(s >= 86400, F.format_string("%dd %dh", part(86400), F.floor(s % 86400 / 3600))).when(s >= 3600, F.format_string("%dh %dm", part(3600), F.floor(s % 3600 / 60)))
        .when(s >= 60, F.format_string("%dm %ds", part(60), s % 60)).otherwise(F.format_string("%ds", s))
    )


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from one time to another, with their part to two digits."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 60e6, 2)


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the rate so far, null without progress."""
    return F.when((done > 0) & (total > done), F.floor(elapsed * (total - done) / done).cast("long"))


def published_date_fallback(df: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Stored date, else the URL's, else the processing date if no more than some days old, as text; else a dash."""
    late = F.when(F.datediff(F.lit(as_of).cast("date"), "processed_date") <= days, F.col("processed_date"))
    return df.withColumn("shown_date", F.coalesce(F.coalesce("published_date", date_from_url(F.col("url"), as_of), late).cast("string"), F.lit("—")))


def to_storage_date(col: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(col).cast("date"), F.try_to_date(F.substring(col, 1, 10), "yyyy-MM-dd"))


def in_forward_window(published: Column, start: Column, days: int) -> Column:
    """From the start and no more than some days after; no start lets all pass, no date none."""
    return F.coalesce(start.isNull() | published.between(start, F.date_add(start, days)), F.lit(False))
