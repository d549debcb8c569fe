"""Matching of names and relevance scores (SF-08 to 19, 50; TK-02)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import hashtags, mentions, without_hashtags

# Words and phrases that begin a trim.
TRIMS = [
    "Limited", "Platinum", "Premium", "Ultimate", "Signature", "Executive", "Elite", "Touring", "Grand Touring", "Luxury", "Reserve", "Ultra Luxury", "Prestige", "Ultra", "Overtrail", "Autobahn",
    "Sport", "S", "RS", "ST", "GT", "GTI", "Type R", "Type S", "SRT", "AMG", "M Sport", "M Performance", "N Line", "N", "TRD", "SS", "Z71", "Raptor", "Rebel", "Trail Boss", "AT4", "Denali", "R/T", "SRT8", "Carbon Edition", "Track Edition", "Performance", "Club",
    "Base", "SE", "SEL", "SL", "SR", "SV", "LX", "EX", "EX-L", "LE", "XLE", "XSE", "L", "LS", "LT", "LTZ", "DX", "Value",
    "TrailHawk", "Rubicon", "Sahara", "Overland", "TRD Pro", "TRD Off-Road", "Trail", "Adventure", "Wilderness", "Badlands", "Bronco Sport", "Big Bend", "Black Diamond", "Outer Banks", "Wildtrak", "ZR2", "FX4", "TrailHunter", "Trail Hunter",
    "Hybrid", "Plug-in Hybrid", "PHEV", "EV", "Electric", "e-tron", "EQS", "Prime", "Energi", "Blue", "e", "h", "Eco", "BlueDrive", "GreenTec",
    "Sedan", "Coupe", "Convertible", "Cabriolet", "Roadster", "Hatchback", "Wagon", "Estate", "Avant", "Sportback", "Gran Coupe", "Gran Turismo", "Crew Cab", "Double Cab", "Extended Cab", "Regular Cab", "King Cab", "Quad Cab", "SuperCab", "SuperCrew", "Access Cab",
    "AWD", "4WD", "FWD", "RWD", "4MATIC", "xDrive", "Quattro", "SH-AWD",
    "Anniversary Edition", "Special Edition", "Launch Edition", "First Edition", "Night Edition", "Black Edition", "Sport Edition", "Nightshade", "TRD Rally", "Pro S", "Pro", "Plus",
    "Long Range", "Extended Range", "Max", "XL", "RF", "Club RF", "Grand Touring RF", "Sport RF",
]
# Makes that mark a URL as of another car.
OTHER_MAKES = ["genesis", "toyota", "honda", "bmw", "mercedes"]
# Trims that leave the base model when they end a name.
BASE_TRIMS = {"limited", "sport", "touring", "premium", "base", "platinum", "signature", "select", "preferred", "le", "xle", "se", "xse", "trd", "lx", "ex", "gt", "turbo", "s", "sv", "sl", "lariat", "laramie"}
# Words that say little about which car it is.
OPTIONAL_WORDS = ["awd", "4wd", "fwd", "rwd", "2wd", "drive", "wheel", "all"]
# Marks of reviews, cars and years in a text.
REVIEW_WORDS = ["review", "test drive", "first drive", "road test", "preview", "impressions"]
AUTO_WORDS = ["mpg", "horsepower", "transmission", "engine", "interior", "exterior", "trunk", "cargo"]
YEARS = ["2024", "2025", "2023"]
# Words of praise and blame.
POSITIVE = ["excellent", "amazing", "outstanding", "impressive", "love", "fantastic", "great", "good"]
NEGATIVE = ["terrible", "awful", "horrible", "hate", "disappointing", "poor", "bad", "worst"]


def _has(text: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms))


def _count(text: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(t)).cast("int") for t in terms))


def split_trim(df: DataFrame, model: str = "model", trims: Sequence[str] = TRIMS, make: Column | None = None) -> DataFrame:
    """base_model and trim_level: the trim begins at the earliest word with which one, two or three words make a known trim, or is a short last word in capitals.

    Of the make Mazda, MX-5 Miata and the CX- numbers are the base and all else is the trim.
    """
    whole = F.trim(F.col(model))
    words = F.split(whole, r"\s+")
    known = F.array(*(F.lit(t.lower()) for t in dict.fromkeys(trims)))
    at = lambda i: F.exists(F.array(*(F.lower(F.array_join(F.slice(words, i, n), " ")) for n in (1, 2, 3))), lambda x: F.array_contains(known, x))
    first = F.try_element_at(F.filter(F.sequence(F.lit(1), F.size(words)), at), F.lit(1))
    last = F.element_at(words, -1)
    short = (F.size(words) >= 2) & (F.upper(last) == last) & (F.lower(last) != last) & (F.length(last) <= 4)
    start = F.coalesce(first, F.when(short, F.size(words)))
    cut = start.isNotNull() & (start > 1)
    rest = F.size(words) - start + 1
    base = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.greatest(start - 1, F.lit(0))), " ")).otherwise(whole)
    level = F.when(cut, F.array_join(F.slice(words, F.greatest(start, F.lit(1)), F.greatest(rest, F.lit(0))), " "))
    if make is not None:
        # The names of this make's models.
        roadster, series = "MX-5 Miata", F.regexp_extract(model, r"(CX-\d+)", 1)
        without = lambda c, *names: F.nullif(F.trim(reduce(lambda t, n: F.replace(t, n, F.lit("")), names, c)), F.lit(""))
        two = F.contains(F.col(model), F.lit("MX-5")) | F.contains(F.col(model), F.lit("Miata"))
        own, numbered = F.coalesce(F.lower(make) == "mazda", F.lit(False)), series != ""
        base = F.when(own & two, roadster).when(own & numbered, series).otherwise(base)
        left = F.coalesce(without(F.col(model), F.lit(roadster)), without(F.col(model), F.lit("MX-5"), F.lit("Miata")))
        level = F.when(own & two, left).when(own & numbered, without(F.col(model), series)).otherwise(level)
    return df.withColumns({"base_model": base, "trim_level": level})


def _variations(make: str, model: str) -> list[str]:
    """Spellings of a model: spaces, hyphens or neither, split or joined numbers, without its trim, and each with the make."""
    make, model = make.lower().strip(), model.lower().strip()
    words = model.split()
    bases = {model}
    cut = next((i for i in range(len(words) - 1, 0, -1) if words[i].replace("-", "") in BASE_TRIMS), None)
    if cut:
        bases.add(" ".join(words[:cut]))
    spelled = {re.sub(r"[\s-]+", sep, b) for b in bases for sep in (" ", "-", "")} | bases
    spelled |= {re.sub(r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", " ", s) for s in spelled}
    spelled |= {re.sub(r"(?<=[a-z])\s+(?=\d)|(?<=\d)\s+(?=[a-z])", "", s) for s in spelled}
    return sorted(v for v in spelled | {f"{make}{sep}{s}" for s in spelled for sep in (" ", "", "-")} if len(v) > 1)


def model_variations(vehicles: DataFrame) -> DataFrame:
    """make, model, variation of each distinct vehicle: a small dimension, to be joined."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(a, b, v) for a, b in zip(pdf["make"], pdf["model"]) for v in _variations(a, b)], columns=["make", "model", "variation"])

    return vehicles.select("make", "model").dropna().distinct().mapInPandas(made, "make string, model string, variation string")


def link_tier_score(links: DataFrame, variations: DataFrame) -> DataFrame:
    """1000 to 300 by whether make, a full variation, base model and variant are in the URL or its title; 0 without."""
    v = variations.groupBy("make", "model").agg(F.collect_set("variation").alias("_v"))
    text = F.lower(F.concat_ws(" ", "url", F.regexp_replace(F.regexp_extract("url", r"([^/]+)/?$", 1), "[-_]", " ")))
    words = F.split(F.lower("model"), " ")
    has = lambda c: F.coalesce(F.contains("_text", c), F.lit(False))
    make, base, variant = has(F.lower("make")), has(F.element_at(words, 1)), has(F.try_element_at(words, F.lit(2)))
    full = F.exists("_v", lambda x: F.contains(F.col("_text"), x))
    score = F.when(make & full, 1000).when(full, 800).when(make & base & variant, 700).when(base & variant, 600).when(make & base, 500).when(base, 300).otherwise(0)
    # the text is made below the join, once a link; in the score it would be made again for every variation
    return links.withColumn("_text", text).join(v, ["make", "model"]).withColumn("tier_score", score).drop("_v", "_text")


def top_links(links: DataFrame, variations: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    from ..operators.windows import keep_best

    scored = link_tier_score(links, variations).filter("tier_score > 0")
    return keep_best(scored, keys, [F.desc("tier_score"), F.asc("url"), F.asc("model")], n)


def title_match(df: DataFrame, title: str = "title", model: str = "model") -> DataFrame:
    """matched: enough of the model's words are in the title: 80 %, two core words, or 60 % with a core word; model numbers must agree."""
    t, m = F.lower(title), F.lower(model)
    number = F.lit(r"\b([a-z]+[-\s]?\d+)\b")
    plain = lambda c: F.transform(F.regexp_extract_all(c, number, F.lit(1)), lambda x: F.regexp_replace(x, r"[-\s]+", ""))
    mine, theirs = plain(m), plain(t)
    partial = F.exists(mine, lambda x: F.exists(theirs, lambda y: (x != y) & (F.contains(x, y) | F.contains(y, x))))
    words = F.filter(F.split(F.regexp_replace(m, r"\b[a-z]+[-\s]?\d+\b", " "), r"[-\s]+"), lambda w: w != "")
    total = F.size(words) + F.size(mine)
    optional = F.array(*(F.lit(w) for w in OPTIONAL_WORDS))
    hits = F.filter(words, lambda w: F.contains(t, w))
    core = F.size(F.filter(hits, lambda w: ~F.array_contains(optional, w)))
    numbers = F.size(F.filter(mine, lambda x: F.array_contains(theirs, x)))
    share = F.try_divide(F.size(hits) + numbers, total)
    wanted = F.filter(words, lambda w: ~F.array_contains(optional, w))
    few = (F.size(wanted) + F.size(mine) <= 2) & F.forall(wanted, lambda w: F.contains(t, w)) & (numbers == F.size(mine))
    ok = (total > 0) & ((share >= 0.8) | (core + numbers >= 2) | ((share >= 0.6) & (core + numbers >= 1)) | few)
    return df.withColumn("matched", F.coalesce(ok & ~((numbers == 0) & partial), F.lit(False)))


def pre_relevance(df: DataFrame, content: str, make: Column, model: Column) -> DataFrame:
    """Score 0 to 10 of a text for a vehicle; 0 below 100 characters."""
    t, a, b = F.lower(content), F.lower(make), F.lower(model)
    pair = F.contains(t, F.concat(a, F.lit(" "), b)) | F.contains(t, F.concat(a, F.lit("-"), b)) | F.contains(t, F.concat(a, b))
    score = (
        F.least(mentions(t, a) * 0.5, F.lit(3.0)) + F.least(mentions(t, b) * 1.0, F.lit(4.0)) + F.when(pair, 2.0).otherwise(0.0) + _count(t, REVIEW_WORDS) * 0.2
        + F.least(_count(t, AUTO_WORDS) * 0.1, F.lit(1.0)) + F.when(_has(t, YEARS), 0.5).otherwise(0.0)
    )
    return df.withColumn("pre_relevance", F.when(F.length(content) >= 100, F.round(F.least(score, F.lit(10.0)), 4)).otherwise(F.lit(0.0)))


def lexicon_analysis(df: DataFrame, content: str, make: Column, model: Column) -> DataFrame:
    """Relevance by mentions, sentiment by words of praise and blame, an overall score within the sentiment's range, alignment."""
    t = F.lower(content)
    rel = F.least(F.lit(10), F.greatest(F.lit(0), (mentions(t, F.lower(make)) + mentions(t, F.lower(model))) * 2))
    good, bad = _count(t, POSITIVE), _count(t, NEGATIVE)
    mood = F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")
    clamp = lambda lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), F.col("lex_relevance")))
    out = df.withColumns({"lex_relevance": rel, "lex_sentiment": mood})
    return out.withColumn("overall_score", F.when(F.col("lex_sentiment") == "positive", clamp(6, 8)).when(F.col("lex_sentiment") == "negative", clamp(2, 4)).otherwise(clamp(4, 7))).withColumn("brand_alignment", F.col("lex_relevance") >= 5)


def social_score(df: DataFrame, make: str = "make", model: str = "model") -> DataFrame:
    """0 to 100 of a post for a vehicle: hashtags 40, title 30, description 20, transcript 10; confidence, with strong hashtags at least medium."""
    a, b, tags = F.lower(make), F.lower(model), F.array_join(hashtags(F.col("description")), " ")
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    plain = F.lower(without_hashtags(F.coalesce("description", F.lit(""))))
    part = F.exists(F.filter(F.split(b, " "), lambda w: F.length(w) > 3), lambda w: F.contains(tags, w))
    tag = F.when(F.contains(tags, a), 20).otherwise(0) + F.when(F.contains(F.replace(tags, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))), 20).when(part, 15).otherwise(0)
    title = F.when(F.contains(text("title"), a), 15).otherwise(0) + F.when(F.contains(text("title"), b), 15).otherwise(0)
    desc = F.when(F.contains(plain, a), 10).otherwise(0) + F.when(F.contains(plain, b), 10).otherwise(0)
    both, one = F.contains(text("transcript"), a) & F.contains(text("transcript"), b), F.contains(text("transcript"), a) | F.contains(text("transcript"), b)
    out = df.withColumns({"hashtag_score": F.coalesce(tag, F.lit(0)), "social_score": F.coalesce(tag, F.lit(0)) + title + desc + F.when(both, 10).when(one, 5).otherwise(0)})
    s = F.col("social_score")
    return out.withColumn("confidence", F.when((F.col("hashtag_score") >= 35) & (s >= 35), "medium").when(s >= 60, "high").when(s >= 40, "medium").when(s >= 25, "low").otherwise("none"))


def validate_social(df: DataFrame, term: Column, seconds: Column) -> DataFrame:
    """Share of 1 from length, words, density of mentions and kinds of words; flags; valid from 0.5 without flags."""
    t = F.lower("text")
    n = F.size(F.split(F.trim("text"), r"\s+"))
    density = F.try_divide(mentions(t, F.lower(term)), n)
    flags = F.array_compact(F.array(F.when(seconds < 15, "too_short"), F.when(n < 20, "few_words"), F.when(_has(t, ["sponsored", "paid partnership"]), "promotion")))
    score = F.when(seconds >= 30, 0.2).otherwise(0.0) + F.when(n >= 50, 0.2).otherwise(0.0) + F.when(density >= 0.01, 0.3).otherwise(0.0) + F.when(_has(t, REVIEW_WORDS), 0.2).otherwise(0.0) + F.when(_has(t, POSITIVE + NEGATIVE), 0.1).otherwise(0.0)
    return df.withColumns({"validation": F.round(score, 2), "flags": F.array_join(flags, ",")}).withColumn("valid", (F.col("validation") >= 0.5) & (F.col("flags") == ""))


# Parts of a review's address, kinds of articles, marks of price lists and of templates, makes and models that are not a Jetta.
REVIEW_PATHS = ["/review", "/first-test", "/road-test"]
ARTICLE_KINDS = ["review", "first test", "first drive", "test drive", "road test"]
PRICE_LISTS = ["expert insights, pricing, and trims", "pricing and trims", "msrp", "specifications", "compare", "top competitors"]
TEMPLATES = ["related posts", "recent posts", "you may also like", "more stories", "other articles", "similar content"]
NOT_JETTA = ["dodge", "charger", "camaro", "mustang", "bmw", "lexus"]


def score_search_results(candidates: DataFrame) -> DataFrame:
    """search_score of a result from its title, snippet, and the model and author that were searched for (quotes in these don't count).

    200 for a review's address in the snippet; 100 if the title has all words of the model, 30 from 70 % of them, else -50; 75 for a word of the
    author in the title, else 50 in the snippet; 50 for each kind of article in the title; -150 for each mark of a price list, -50 for each of a template;
    -200 for each wrong car, if a Jetta is looked for; 10 if recent; 15 for a snippet of over 200 characters. Null counts as empty, and asks for nothing.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    title, snippet = low("title"), low("snippet")
    words = lambda c: F.filter(F.split(F.replace(low(c), F.lit('"'), F.lit("")), r"\s+"), lambda w: w != "")
    model, author = words("model"), words("author")
    if_ = lambda hit, points: F.when(hit, points).otherwise(0)
    share = F.coalesce(F.try_divide(F.size(F.filter(model, lambda w: F.contains(title, w))), F.size(model)), F.lit(0.0))
    by = lambda text: F.exists(author, lambda w: F.contains(text, w))
    score = if_(_has(snippet, REVIEW_PATHS), 200) + if_(F.coalesce("model", F.lit("")) != "", F.when(share >= 1, 100).when(share >= 0.7, 30).otherwise(-50))
    score = score + F.when(by(title), 75).when(by(snippet), 50).otherwise(0) + 50 * _count(title, ARTICLE_KINDS)
    for mark in PRICE_LISTS:
        score = score - if_(F.contains(title, F.lit(mark)) | F.contains(snippet, F.lit(mark)), 150)
    score = score - 50 * _count(snippet, TEMPLATES) - if_(F.contains(low("model"), F.lit("jetta")), 200 * _count(title, NOT_JETTA))
    score = score + if_(F.contains(snippet, F.lit("days ago")) | F.contains(title, F.lit("2025")), 10) + if_(F.length(snippet) > 200, 15)
    return candidates.withColumn("search_score", score)


def score_url(candidates: DataFrame) -> DataFrame:
    """Points for make, model, a word of the author, a review or test and a recent year in a URL; less for other makes and for another number of the model's series; not below 0.

    A model with a hyphen, or of several words, must stand in the URL whole.
    """
    u, make, m = F.lower("url"), F.lower("make"), F.replace(F.lower("model"), F.lit(" "), F.lit("-"))
    if_ = lambda hit, points: F.when(hit, points).otherwise(0)
    parts = F.split(m, "-")
    series, number = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    hyphened = F.contains(m, F.lit("-"))
    score = if_(F.contains(u, make), 30) + F.when(hyphened, if_(F.contains(u, m), 100)).otherwise(if_(F.contains(u, m), 40))
    if "author" in candidates.columns:
        score = score + if_(F.exists(F.split(F.lower("author"), r"\s+"), lambda w: (w != "") & F.contains(u, w)), 20)
    score = score + if_(_has(u, ["review", "test"]), 20) + if_(_has(u, ["2025", "2024"]), 10)
    for other in OTHER_MAKES:
        score = score - if_(F.contains(u, F.lit(other)) & (make != other) & (series != other), 50)
    # Numbers that follow the series in the URL; those that begin with the model's own number are its own.
    quoted = F.regexp_replace(series, r"([^\p{L}\p{N}])", r"\\$1")
    others = F.filter(F.regexp_extract_all(u, F.concat(quoted, F.lit("-([0-9]+)")), F.lit(1)), lambda x: ~F.startswith(x, number))
    score = score - if_(hyphened & (F.size(others) > 0), 200)
    return candidates.withColumn("url_score", F.coalesce(F.greatest(score, F.lit(0)), F.lit(0)))


def title_shortcut(df: DataFrame) -> DataFrame:
    """Relevance 8 where the model is in title and text of 1000 characters or more, 0 for texts below 100; else open (null)."""
    hit = F.contains(F.lower("title"), F.lower("model")) & F.contains(F.lower("text"), F.lower("model"))
    return df.withColumn("shortcut", F.when(F.length(F.coalesce("text", F.lit(""))) < 100, 0).when(hit & (F.length("text") >= 1000), 8))


def high_quality(df: DataFrame, min_relevance: int = 8) -> DataFrame:
    return df.filter(F.col("relevance") >= min_relevance)
