"""Text columns (SF-02, 03, 27 to 32, 34, 35, 38, 39, 41 to 44, 48)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of any script, for patterns.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def with_search_model(loans: DataFrame) -> DataFrame:
    """The short model name where there is one, else the full one."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return loans.withColumn("search_model", F.coalesce(blank("model_short"), blank("model_full")))


def clean_ids(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ids as text without commas; NaN and blanks as null."""
    for c in cols:
        text = F.trim(F.regexp_replace(F.col(c).cast("string"), ",", ""))
        df = df.withColumn(c, F.when(F.lower(text).isin("", "nan", "inf", "-inf", "none"), None).otherwise(text))
    return df


def clean_number(col: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col)


_TITLES = r"(?i)\b(mr|mrs|ms|dr|prof)\.?\s+"


def _plain(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), _TITLES, ""), r"\s+", " "))


def attribution(contact: Column, byline: Column) -> Column:
    """strong: same name or one holds the other; partial: same last name; delegated: another name; unknown: none."""
    c, b = _plain(contact), _plain(byline)
    last = lambda x: F.element_at(F.split(x, " "), -1)
    return (
        F.when(byline.isNull() | (b == "") | contact.isNull() | (c == ""), "unknown").when((c == b) | F.contains(b, c) | F.contains(c, b), "strong").when(last(c) == last(b), "partial").otherwise("delegated")
    )


def choose_byline(df: DataFrame) -> DataFrame:
    """The stored byline unless a placeholder or a "Posted: .. Author:" line, else the contact, else a dash."""
    b = F.trim(F.col("byline"))
    bad = b.isNull() | F.lower(b).isin("", "none", "unknown", "n/a", "—") | b.rlike(r"(?i)posted:.*author:")
    return df.withColumn("shown_byline", F.when(~bad, b).otherwise(F.coalesce("contact", F.lit("—"))))


def hashtags(col: Column) -> Column:
    return F.transform(F.regexp_extract_all(col, F.lit(r"#(\w+)"), F.lit(1)), F.lower)


def without_hashtags(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"#\w+", ""))


def engagement_rate(likes: Column, comments: Column, shares: Column, views: Column) -> Column:
    return F.when(views > 0, F.round((likes + comments + shares) / views, 3)).otherwise(F.lit(0.0))


def flatten_post(df: DataFrame, node: str = "node") -> DataFrame:
    """A nested post as flat columns, with fall-backs for names, and zero for missing counts."""
    g = lambda path: F.col(f"{node}.{path}")
    count = lambda *paths: F.coalesce(*(g(p) for p in paths), F.lit(0)).cast("long")
    return df.select(
        g("id").alias("post_id"), g("contentUrl").alias("post_url"), F.coalesce(g("network"), F.lit("Unknown")).alias("platform"), g("contentType").alias("content_type"),
        F.coalesce(g("creator.fullName"), g("creator.primarySocialUsername"), g("account.socialUsername"), F.lit("Unknown")).alias("creator_name"),
        F.coalesce(g("account.socialUsername"), g("creator.primarySocialUsername")).alias("username"), F.to_date(F.try_to_timestamp(g("publishedAt"))).cast("string").alias("date"), g("text").alias("caption"),
        count("combinedMetrics.combinedImpressions.value").alias("impressions"), count("combinedMetrics.combinedEngagements.value").alias("engagements"),
        count("combinedMetrics.combinedLikes.value", "organicMetrics.likes").alias("likes"), count("organicMetrics.comments").alias("comments"), g("thumbnailURL").alias("thumbnail_url"),
    )


def repair_json(df: DataFrame, col: str, schema: str) -> DataFrame:
    """JSON from a model's answer: fence, text around the outer braces, trailing commas and control characters go; parsed as repaired."""
    text = F.regexp_replace(F.regexp_replace(F.col(col), r"(?s)^.*?```(?:json)?", ""), r"(?s)```.*$", "")
    text = F.when(F.contains(F.col(col), F.lit("```")), text).otherwise(F.col(col))
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    inner = F.regexp_replace(F.regexp_replace(inner, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r",\s*([}\]])", "$1")
    return df.withColumn("repaired_text", F.nullif(inner, F.lit(""))).withColumn("repaired", F.from_json("repaired_text", schema))


def sentiment_columns(df: DataFrame, col: str = "sentiment_json") -> DataFrame:
    """Classification and array lengths of a sentiment document as columns; zero where there is no array."""
    path = lambda p: F.get_json_object(col, p)
    n = lambda p: F.coalesce(F.json_array_length(path(p)), F.lit(0))
    return df.withColumns({
        "classification": path("$.sentiment_classification.overall"), "features_count": n("$.key_features_mentioned"),
        "attributes_count": F.when(n("$.brand_attributes_captured") > 0, n("$.brand_attributes_captured")).otherwise(n("$.brand_attributes_identified")), "drivers_count": n("$.purchase_drivers"),
    })


def clean_text(col: Column) -> Column:
    """Runs of white space as single spaces, then boilerplate phrases left out."""
    # Phrases that pages carry around their text.
    phrases = ["accept all cookies", "privacy policy", "terms of service", "advertisement", "subscribe now"]
    return F.trim(F.regexp_replace(F.regexp_replace(col, SPACE + "+", " "), "(?i)(" + "|".join(phrases) + ")", ""))


def quality_of(text: Column, topic: Column, url: Column | None = None) -> Column:
    """good, or why not: too_short, navigation, sidebar, off_topic (none of the words of a topic of several), fragmented (short lines)."""
    # The site of flip books whose texts may be shorter, and marks of their controls, looked for in the text without spaces.
    flip_site = "spotlightepnews.com"
    controls = ["firstprevious page", "nextpagelast", "return homezoom", "thumbnailsauto flip", "social sharefullscreen", "emailmoremore"]
    # Marks of side bars.
    marks = ["recent posts", "related posts", "you may also like", "more stories", "categories:", "tags:", "share this:", "follow us", "subscribe", "advertisement", "sponsored content", "continue reading", "popular articles", "trending now", "recommended for you"]
    bare = lambda c: F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
    count = lambda c, parts: sum((F.contains(c, F.lit(m)).cast("int") for m in parts), F.lit(0))
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  what f names many times is worked out once
    host = F.lit("") if url is None else F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    least = F.when(F.contains(host, F.lit(flip_site)), 100).otherwise(200)
    topics = F.filter(F.split(F.lower(topic), SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split(text, "\n"), bare), lambda x: x != "")
    fragmented = once(lines, lambda ls: (F.size(ls) > 5) & (F.size(F.filter(ls, lambda x: F.length(x) < 50)) > 0.7 * F.size(ls)))

    def of(t: Column) -> Column:
        """The verdict on a text that is long enough, from its lower case."""
        return (
            F.when(once(F.replace(t, F.lit(" "), F.lit("")), lambda c: count(c, controls)) >= 2, "navigation")
            .when(count(t, marks) >= 2, "sidebar")
            .when((F.size(topics) > 1) & ~F.exists(topics, lambda w: F.contains(t, w)), "off_topic")
            .when(fragmented, "fragmented")
            .otherwise("good")
        )

    verdict = F.when(F.length(bare(text)) < least, "too_short").otherwise(once(F.lower(text), of))
    return F.when(text.isNull(), "too_short").otherwise(verdict)


def content_quality(df: DataFrame, text: str, topic: Column, url: Column | None = None) -> DataFrame:
    """quality_verdict of a column of texts."""
    return df.withColumn("quality_verdict", quality_of(F.col(text), topic, url))


def content_specificity(df: DataFrame, text: str, make: Column, model: Column) -> DataFrame:
    """specific with two or more mentions of the model, mention with one, generic without."""
    t, m = F.lower(text), F.lower(model)
    n = mentions(t, m)
    return df.withColumn("specificity", F.when((n >= 2) & F.contains(t, F.lower(make)), "specific").when(n >= 1, "mention").otherwise("generic"))


def mentions(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term; none of an empty one."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")).otherwise(0)


def excerpt(text: Column, term: Column, before: int = 200, size: int = 6000) -> Column:
    """A part of a text around the first mention (from its start without one), with dots where it is cut."""
    first = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(first - before, F.lit(1))
    part = F.substring(text, start, F.lit(size))
    return F.concat(F.when(start > 1, "...").otherwise(""), part, F.when(F.length(text) >= start + size, "...").otherwise(""))


def sentence_cut(text: Column, size: int) -> Column:
    """No more than size characters, ended at a full stop if one lies in the last fifth."""
    part = F.substring(text, 1, size)
    last = F.length(part) - F.instr(F.reverse(part), ".") + 1
    return F.when(F.length(text) <= size, text).when((F.instr(part, ".") > 0) & (last >= 0.8 * size), F.substring(part, F.lit(1), last)).otherwise(part)


def marketing_sections(text: Column, markers: Sequence[str], size: int = 3000, n: int = 8) -> Column:
    """Windows from the first place of each marker, in the markers' order, no more than n."""
    windows = [F.when(F.instr(F.lower(text), m.lower()) > 0, F.substring(text, F.instr(F.lower(text), m.lower()), F.lit(size))) for m in markers]
    return F.slice(F.array_compact(F.array(*windows)), 1, n)


def assemble_transcript(segments: DataFrame, k: str, seq: str, text: str = "text") -> DataFrame:
    """Segments in order as one text with single spaces."""
    parts = F.array_sort(F.collect_list(F.struct(seq, F.coalesce(text, F.lit("")).alias("t"))))
    joined = F.array_join(F.transform(parts, lambda p: p["t"]), " ")
    return segments.groupBy(k).agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("transcript"))


def detect_language(text: Column) -> Column:
    """Of the first 2000 characters: ar by share of Arabic letters, es and fr by three common words, else en; en for texts under 50 characters."""
    # Common words, of which one counts twice.
    spanish = ["el ", "la ", "de ", "que ", "y ", "en ", "un ", "es ", "se ", "no "]
    french = ["le ", "de ", "et ", "à ", "un ", "il ", "être ", "et ", "en ", "avoir "]
    sample = F.lower(F.substring(text, 1, 2000))
    count = lambda words: sum((F.contains(sample, F.lit(w)).cast("int") for w in words), F.lit(0))
    arabic = F.length(sample) - F.length(F.regexp_replace(sample, r"[\u0600-\u06FF]", ""))
    found = F.when(F.length(text) < 50, "en").when(arabic > 0.1 * F.length(sample), "ar").when(count(spanish) >= 3, "es").when(count(french) >= 3, "fr")
    return F.coalesce(found, F.lit("en"))


def display_labels(df: DataFrame, mapping: dict[str, str], col: str, out: str = "label") -> DataFrame:
    found = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.withColumn(out, F.coalesce(F.try_element_at(found, F.col(col)), F.col(col)))


def parse_search_log(lines: DataFrame, order: str = "line_no", k: str = "file") -> DataFrame:
    """Log lines with the attempt they belong to, its query and results, carried forward within each file."""
    from pyspark.sql import Window as W

    w = W.partitionBy(k).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    attempt = F.regexp_extract("line", r"(?i)attempt\s+(\d+)", 1).try_cast("int")
    out = lines.withColumn("attempt", F.last(attempt, ignorenulls=True).over(w))
    return out.withColumns({"query": F.nullif(F.regexp_extract("line", r"(?i)query:\s*(.+)$", 1), F.lit("")), "found": F.regexp_extract("line", r"(?i)found\s+(\d+)\s+results?", 1).try_cast("int")})
