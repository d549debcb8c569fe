"""URL columns (SF-01, 04 to 07, 37; PF-13 to 16, 18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Paths that are not an article, as whole path or last part.
INDEX_PATHS = ["", "index.html", "index.php", "home", "main", "category/car-reviews", "car-reviews", "reviews", "blog", "news", "articles", "page/1", "page/2", "page/3", "page/4", "page/5"]
# Parts of listing paths, and what marks an article in spite of them.
LISTING_PARTS = ["/category/", "/tag/", "/archives/", "/page/", "/reviews/", "/news/", "/blog/"]
ARTICLE_MARKS = ["2024", "2025", "review-", "-test-", "-drive-"]
# Parts of paths that are no article.
NO_ARTICLE = ["/search", "/category", "/tag", "/author", "/page/", "/index", "/sitemap", "/feed", ".pdf", ".jpg", ".png", ".gif"]
# Marks of old years in a URL.
OLD_YEARS = ["/2019/", "/2020/", "/2021/", "/2022/", "/2023/", "2019-", "2020-", "2021-", "2022-", "2023-"]
# Marks of archived pages.
ARCHIVE_MARKS = ["archive", "wayback", "cached"]


def _any_in(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def url_list(col: str, internal_prefix: str | None = None) -> Column:
    """Text of URLs as an array: by comma, or by semicolon without a comma; trimmed, unquoted, without internal ones."""
    c = F.col(col)
    parts = F.when(F.contains(c, F.lit(",")), F.split(c, ",")).otherwise(F.split(c, ";"))
    clean = F.transform(parts, lambda u: F.trim(F.regexp_replace(F.trim(u), "^[\"']+|[\"']+$", "")))
    keep = F.filter(clean, lambda u: u != "")
    return keep if internal_prefix is None else F.filter(keep, lambda u: ~F.startswith(u, F.lit(internal_prefix)))


def explode_urls(loans: DataFrame, col: str = "links", internal_prefix: str | None = None) -> DataFrame:
    """A row per URL with its position from 1; loans without URLs give none."""
    return loans.select("*", F.posexplode(url_list(col, internal_prefix)).alias("_pos", "url")).withColumn("url_pos", F.col("_pos") + 1).drop("_pos")


def domain(url: Column) -> Column:
    """Lower-case host without www., null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def cache_key(url: Column, make: Column, model: Column) -> Column:
    return F.concat_ws(":", domain(url), F.lower(make), F.lower(model))


def platform(url: Column) -> Column:
    u = F.lower(url)
    return (
        F.when(F.contains(u, F.lit("youtube.com")) | F.contains(u, F.lit("youtu.be")), "youtube").when(F.contains(u, F.lit("tiktok.com")), "tiktok")
        .when(F.contains(u, F.lit("instagram.com")), "instagram").otherwise("web")
    )


def media_id(url: Column) -> Column:
    """Id of a video in a URL, null where there is none."""
    forms = [r"[?&]v=([\w-]{6,})", r"youtu\.be/([\w-]{6,})", r"/embed/([\w-]{6,})", r"/shorts/([\w-]{6,})", r"/video/(\d+)"]
    return F.coalesce(*(F.nullif(F.regexp_extract(url, f, 1), F.lit("")) for f in forms))


def rewrite_urls(df: DataFrame, rules: Sequence[tuple[str, str]], col: str = "url") -> DataFrame:
    """URLs with hosts replaced by rules of (old, new), the first that fits."""
    out = F.col(col)
    chain = F.lit(None).cast("string")
    for old, new in reversed(list(rules)):
        chain = F.when(F.contains(F.col(col), F.lit(old)), F.replace(F.col(col), F.lit(old), F.lit(new))).otherwise(chain)
    return df.withColumn("actual_url", F.coalesce(chain, out))


def is_index_url(url: Column) -> Column:
    """Home, index and listing pages."""
    path = F.trim(F.coalesce(F.try_parse_url(F.lower(url), F.lit("PATH")), F.lit("")))
    path = F.regexp_replace(path, "^/+|/+$", "")
    whole = path.isin(*INDEX_PATHS)
    for p in INDEX_PATHS[1:]:
        whole = whole | F.endswith(path, F.lit("/" + p))
    return whole | (_any_in(path, LISTING_PARTS) & ~_any_in(path, ARTICLE_MARKS))


def is_article_url(url: Column) -> Column:
    """Neither empty nor, by its path, a listing, a feed or a media file; other parts of the URL don't count."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.coalesce((url != "") & ~_any_in(path, NO_ARTICLE), F.lit(False))


def is_old_url(url: Column, as_of: str) -> Column:
    """Whether the first year in the path, ended by a slash or hyphen, is before that of as_of less one, or a year known to be old stands in it."""
    first = F.regexp_extract(url, r"/([0-9]{4})[-/]", 1).try_cast("int")
    return F.coalesce(first < F.year(F.lit(as_of).cast("date")) - 1, F.lit(False)) | F.coalesce(_any_in(url, OLD_YEARS), F.lit(False))


def is_index_page(url: Column, raw_len: Column, text_len: Column) -> Column:
    """A large page with little text, or a listing path with under 2 % of text."""
    return ((raw_len > 50_000) & (text_len < 1_000)) | (is_index_url(url) & (text_len < 0.02 * raw_len))


def authorised_urls(urls: DataFrame, outlets: DataFrame) -> DataFrame:
    """Whether a person's URL is of one of their outlets; persons without outlets may use any. reason names the outlet (the one of the least id) or why.

    outlets(person_id, outlet_id, outlet_name, outlet_url). Each host of a person is looked up once: it and what follows each of its dots meet
    the outlets' hosts by an equi-join, and what was found goes back to the rows.
    """
    hosted = urls.withColumn("_host", domain(F.col("url")))
    looked = hosted.select("person_id", "_host").distinct()
    parts = F.split("_host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    least = outlets.select("person_id", domain(F.col("outlet_url")).alias("_above"), "outlet_id", "outlet_name").filter("_above IS NOT NULL").groupBy("person_id", "_above").agg(F.min(F.struct("outlet_id", "_above", "outlet_name")).alias("_outlet"))
    met = looked.filter("_host IS NOT NULL").withColumn("_above", F.explode(above)).join(least, ["person_id", "_above"]).groupBy("person_id", "_host").agg(F.min("_outlet").alias("_outlet"))
    known = outlets.select("person_id").distinct().withColumn("_known", F.lit(True))
    found = looked.join(known, "person_id", "left").join(met, ["person_id", "_host"], "left").select(F.col("person_id").alias("_person"), F.col("_host").alias("_of"), "_known", "_outlet")
    allowed = F.col("person_id").isNull() | F.col("_known").isNull() | F.col("_outlet").isNotNull()
    reason = F.when(F.col("person_id").isNull(), "No person_id provided").when(F.col("_known").isNull(), "Person not in mapping").otherwise(F.coalesce("_outlet.outlet_name", F.lit("Not from authorized outlets")))
    # every row has its look-up, nulls as well; from the left, so that a frequent host may be split
    rows = hosted.join(found, F.col("person_id").eqNullSafe(F.col("_person")) & F.col("_host").eqNullSafe(F.col("_of")), "left")
    return rows.withColumns({"allowed": allowed, "reason": reason}).drop("_host", "_person", "_of", "_known", "_outlet")


def on_topic(df: DataFrame, text_cols: Sequence[str], terms: Sequence[str]) -> DataFrame:
    text = F.lower(F.concat_ws(" ", *text_cols))
    return df.filter(_any_in(text, [t.lower() for t in terms]))


def first_source_url(df: DataFrame, col: str = "original_urls") -> DataFrame:
    """The first URL of a JSON list or of separated text."""
    listed = F.from_json(col, "array<string>")
    return df.withColumn("source_url", F.coalesce(F.try_element_at(listed, F.lit(1)), F.try_element_at(url_list(col), F.lit(1))))


def searched_urls(details: Column) -> Column:
    """The URLs of a rejection's details ("URL: what came of it; ..."), one a line; says so where there are none, or no details."""
    parts = F.filter(F.transform(F.split(details, ";"), lambda d: F.trim(d)), lambda d: d.rlike("^https?://"))
    urls = F.transform(parts, lambda d: F.trim(F.split_part(d, F.lit(": "), F.lit(1))))
    return F.when(F.coalesce(details, F.lit("")) == "", "No URLs processed").when(F.size(urls) == 0, "No URLs found").otherwise(F.array_join(urls, "\n"))
