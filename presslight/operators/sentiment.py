"""Aggregates over nested sentiment documents and intended messages (AG-02 to 05, 13 to 23)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .joins import semantic_match, substring_all_matches

DOCUMENT = """struct<sentiment_classification: struct<overall: string, confidence: double, rationale: string>,
key_features_mentioned: array<struct<feature: string, sentiment: string, quote: string>>,
brand_attributes_captured: array<struct<attribute: string, sentiment: string, evidence: string>>, brand_attributes_identified: array<string>,
purchase_drivers: array<struct<reason: string, sentiment: string, strength: string, quote: string>>,
competitive_context: struct<direct_comparisons: array<string>, market_positioning: string>>"""

#: Up to so many pairs of labels, they are sent to every task; more of them meet what is said by shuffles.
SENT = 200_000
KINDS = ("feature", "attribute", "driver")


#: The array fields of a document whose items are counted.
ITEMS = {
    "key_features_mentioned": "array<struct<feature: string, sentiment: string, quote: string>>", "brand_attributes_captured": "array<struct<attribute: string, sentiment: string, evidence: string>>",
    "purchase_drivers": "array<struct<reason: string, sentiment: string, strength: string, quote: string>>",
}


def documents(clips: DataFrame, col: str = "sentiment_json") -> DataFrame:
    """Clips with the parsed document as doc; text that isn't one gives null."""
    return clips.withColumn("doc", F.from_json(col, DOCUMENT, {"mode": "PERMISSIVE"}))


def _elements(clips: DataFrame, field: str, col: str = "sentiment_json") -> DataFrame:
    """The elements of one array field of the documents, as x. No other field is converted, and a text is parsed once: no filter is pushed through the outer explosion."""
    doc = F.from_json(col, f"struct<{field}: {ITEMS[field]}>", {"mode": "PERMISSIVE"})
    return clips.select(F.explode(F.array(doc)).alias("doc")).select(F.explode(f"doc.{field}").alias("x"))


def _of(clips: DataFrame, make=None, model=None, date_from=None, date_to=None) -> DataFrame:
    for col, value in (("make", make), ("model", model)):
        if value is not None:
            clips = clips.filter(F.col(col) == value)
    if date_from is not None:
        clips = clips.filter(F.col("published_date") >= F.lit(date_from).cast("date"))
    return clips if date_to is None else clips.filter(F.col("published_date") <= F.lit(date_to).cast("date"))


def _items(clips: DataFrame, field: str, name: str, states: dict[str, Sequence[str]], quote: str, n: int) -> DataFrame:
    """Elements of an array field by name: total, a count for each state of each key, distinct quotes (the first n, sorted)."""
    x = _elements(clips, field)
    counts = [F.count_if(F.col(f"x.{key}") == s).alias(s) for key, ss in states.items() for s in ss]
    quotes = F.concat_ws("|", F.slice(F.array_sort(F.collect_set(f"x.{quote}")), 1, n)).alias("quotes")
    return x.filter(F.col(f"x.{name}").isNotNull()).groupBy(F.col(f"x.{name}").alias(name)).agg(F.count("*").alias("total"), *counts, quotes)


def aggregate_features(clips: DataFrame, make=None, model=None, date_from=None, date_to=None) -> DataFrame:
    return _items(_of(clips, make, model, date_from, date_to), "key_features_mentioned", "feature", {"sentiment": ("positive", "neutral", "negative")}, "quote", 5)


def aggregate_attributes(clips: DataFrame, make=None, model=None, date_from=None, date_to=None) -> DataFrame:
    return _items(_of(clips, make, model, date_from, date_to), "brand_attributes_captured", "attribute", {"sentiment": ("reinforced", "neutral", "challenged")}, "evidence", 5)


def aggregate_drivers(clips: DataFrame, make=None, model=None, date_from=None, date_to=None) -> DataFrame:
    """Drivers by positive and negative, primary and secondary mentions; most primary first, then total, then name."""
    out = _items(_of(clips, make, model, date_from, date_to), "purchase_drivers", "reason", {"sentiment": ("positive", "negative"), "strength": ("primary", "secondary")}, "quote", 5)
    return out.orderBy(F.desc("primary"), F.desc("total"), "reason")


def vehicle_summary(clips: DataFrame, make=None, model=None, date_from=None, date_to=None) -> DataFrame:
    """Sections of a vehicle's summary as rows (section, item, n): sentiment, top features, attributes, drivers, competitors."""
    docs = documents(_of(clips, make, model, date_from, date_to))
    overall = F.col("doc.sentiment_classification.overall")
    overall = F.when(overall.isin("positive", "neutral", "negative"), overall).otherwise("other")
    parts = [docs.groupBy(overall.alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("sentiment"))]
    for section, field, name, n in (("feature", "key_features_mentioned", "feature", 10), ("attribute", "brand_attributes_captured", "attribute", 5), ("driver", "purchase_drivers", "reason", 5)):
        by = docs.select(F.explode(f"doc.{field}").alias("x")).groupBy(F.col(f"x.{name}").alias("item")).agg(F.count("*").alias("n"))
        parts.append(by.orderBy(F.desc("n"), "item").limit(n).withColumn("section", F.lit(section)))
    rivals = docs.select(F.explode("doc.competitive_context.direct_comparisons").alias("c")).select(F.trim(F.split_part("c", F.lit(":"), F.lit(1))).alias("item"))
    parts.append(rivals.groupBy("item").agg(F.count("*").alias("n")).withColumn("section", F.lit("competitor")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("section", "item", "n")


def oem_document(models: DataFrame, **children: DataFrame) -> DataFrame:
    """A JSON document per model, with the children (model_id, position, item, ..) as ordered arrays."""
    out = models
    for name, child in children.items():
        fields = [c for c in child.columns if c not in ("model_id", "position")]
        rows = child.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias("_a"))
        out = out.join(rows.select("model_id", F.transform("_a", lambda s: F.struct(*(s[f].alias(f) for f in fields))).alias(name)), "model_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.filter(F.array(F.struct(*(F.lit(None).cast(child.schema[f].dataType).alias(f) for f in fields))), lambda s: F.lit(False))))
    return out.select("model_id", F.to_json(F.struct(*(c for c in out.columns if c != "model_id"))).alias("document"))


def _clean(df: DataFrame, *cols: str) -> DataFrame:
    """Lower-cased, trimmed, non-empty items."""
    return df.select(*cols, F.lower(F.trim("item")).alias("item")).filter(F.col("item") != "")


def matched_mentions(intended: DataFrame, mentions: DataFrame, all_matches: bool = False) -> DataFrame:
    """mentions(make, review, item, sentiment) with the first intended item (or each) that touches theirs, null where none does.

    Labels are matched once per make, and the matches joined to the mentions.
    """
    m = mentions.withColumn("item", F.lower(F.trim("item"))).filter(F.col("item") != "")
    pairs = substring_all_matches(m, intended.withColumnRenamed("item", "intended"), ["make"], "item", "intended")
    if not all_matches:
        pairs = pairs.groupBy("make", "item").agg(F.min("intended").alias("intended"))
    return m.join(pairs, ["make", "item"], "left")


def feature_coverage(intended: DataFrame, mentions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per intended item: reviews that mention it, share of all reviews of the make, mentions by sentiment."""
    n = reviews.groupBy("make").agg(F.count_distinct("review").alias("n_reviews"))
    hits = matched_mentions(intended, mentions).filter("intended IS NOT NULL").groupBy("make", "intended").agg(
        F.count_distinct("review").alias("reviews"), F.count("*").alias("mentions"), *(F.count_if(F.coalesce("sentiment", F.lit("neutral")) == s).alias(s) for s in ("positive", "neutral", "negative"))
    )
    out = _clean(intended, "make").distinct().withColumnRenamed("item", "intended").join(hits, ["make", "intended"], "left").join(n, "make", "left").fillna(0, ["reviews", "mentions", "positive", "neutral", "negative", "n_reviews"])
    return out.withColumn("coverage", F.round(F.when(F.col("n_reviews") > 0, 100.0 * F.col("reviews") / F.col("n_reviews")).otherwise(0.0), 4))


def pullthrough_model(intended: DataFrame, reviews: DataFrame) -> DataFrame:
    """intended(make, kind, item[, position]), reviews(make, review, sentiment and features, attributes, drivers as arrays of struct(item, sentiment)) -> a row for each make with intended items.

    It has the number of reviews, the shares of intended features mentioned (and of those in a fifth of the reviews at least, which is consistency),
    of attributes reinforced and of drivers positive, the mean of these three, and the shares of reviews by sentiment. What a review
    says of a feature or driver counts for the first intended one that it touches, by position (or in their own order), of an attribute for each.
    An item without sentiment is neutral, a review without none of the three. Rows of one review are taken together; of their sentiments
    negative goes before neutral, neutral before positive.

    Reviews are read twice: for the different labels, which are matched, and to count features and sentiments by review, in one shuffle.
    """
    k, at = ["make", "kind"], "position" in intended.columns
    i = _clean(intended, *k, *(["position"] if at else [])).groupBy(*k, F.col("item").alias("intended")).agg((F.min("position") if at else F.first(F.lit(0))).alias("_pos"))
    i = kept(i, "intended")
    of_kinds = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}s").alias("items")) for kind in KINDS))).alias("x")
    said = reviews.select("make", of_kinds).select("make", "x.kind", F.explode("x.items").alias("x")).select(*k, "x.*").distinct()
    good = F.lower("sentiment") == F.when(F.col("kind") == "attribute", "reinforced").otherwise("positive")
    labels = kept(_clean(said.withColumn("good", F.coalesce(good, F.lit(False))), *k, "good").groupBy(*k, "item").agg(F.bool_or("good").alias("good")), "labels")
    touched = substring_all_matches(labels, i, k, "item", "intended").join(i, [*k, "intended"]).withColumn("_n", F.row_number().over(W.partitionBy(*k, "item").orderBy("_pos", "intended")))
    pairs = kept(touched.filter("kind = 'attribute' OR _n = 1").join(labels, [*k, "item"]).select(*k, "item", "intended", "good"), "pairs")
    hits = pairs.groupBy(*k, "intended").agg(F.bool_or("good").alias("good"))

    features = pairs.filter("kind = 'feature'").select("make", "item", "intended").hint("broadcast" if pairs.count() <= SENT else "merge")
    dealt = reviews.select("make", "review", F.lower("sentiment").alias("sentiment"), F.col("features.item").alias("items")).repartition("make", "review")
    none = F.array().cast("array<string>")
    # each row's sentiment is a row of no item, so that a review counts whatever it says
    rows = dealt.select("make", "review", "sentiment", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("items", none))).alias("item")).withColumn("item", F.lower(F.trim("item")))
    met = rows.join(features, ["make", "item"], "left").filter("item IS NULL OR intended IS NOT NULL")
    by_review = met.groupBy("make", "review", "intended").agg(*(F.bool_or(F.col("sentiment") == x).alias(x) for x in ("negative", "neutral", "positive")))
    sentiments = {"negative": F.expr("negative"), "neutral": F.expr("neutral AND NOT negative"), "positive": F.expr("positive AND NOT neutral AND NOT negative")}
    counts = kept(by_review.groupBy("make", "intended").agg(F.count("*").alias("reviews"), *(F.count_if(c).alias(name) for name, c in sentiments.items())), "counts")

    by_make = counts.filter("intended IS NULL").select("make", F.col("reviews").alias("n_reviews"), *sentiments)
    mentions = counts.select("make", F.lit("feature").alias("kind"), "intended", "reviews")
    items = i.join(hits, [*k, "intended"], "left").join(mentions, [*k, "intended"], "left").join(by_make, "make", "left").fillna(0, ["reviews", "n_reviews", *sentiments])

    def share(kind: str, hit: Column, name: str) -> Column:
        n = F.count_if(F.col("kind") == kind)
        return F.round(F.when(n > 0, 100.0 * F.count_if((F.col("kind") == kind) & hit) / n).otherwise(0.0), 4).alias(name)

    out = items.groupBy("make").agg(
        F.max("n_reviews").alias("n_reviews"), share("feature", F.col("good").isNotNull(), "features_pct"),
        share("feature", F.col("reviews") >= F.greatest(F.floor(0.2 * F.col("n_reviews")), F.lit(1)), "consistency_pct"), share("attribute", F.col("good"), "attributes_pct"), share("driver", F.col("good"), "drivers_pct"),
        *(F.round(100.0 * F.max(x) / F.greatest(F.max("n_reviews"), F.lit(1)), 4).alias(f"{x}_pct") for x in ("positive", "neutral", "negative")),
    )
    return out.withColumn("alignment_pct", F.round((F.col("features_pct") + F.col("attributes_pct") + F.col("drivers_pct")) / 3, 3))


def emergent_features(intended: DataFrame, mentions: DataFrame, n: int = 10) -> DataFrame:
    """Mentioned items that no intended one touches, the n most frequent of each make."""
    by = matched_mentions(intended, mentions).filter("intended IS NULL").groupBy("make", "item").agg(F.count("*").alias("mentions"))
    return by.withColumn("rank", F.row_number().over(W.partitionBy("make").orderBy(F.desc("mentions"), "item"))).filter(F.col("rank") <= n)


def wins_and_gaps(coverage: DataFrame, win_cov: float = 20.0, pos_share: float = 0.5) -> DataFrame:
    """Per make the top wins (or, without any, promising ones) and gaps, ranked."""
    total = F.col("positive") + F.col("neutral") + F.col("negative")
    c = coverage.withColumn("share", F.when(total > 0, F.col("positive") / total).otherwise(0.0))
    win = (F.col("coverage") >= win_cov) & (F.col("share") >= pos_share) & (total > 0)
    c = c.withColumn("_any", F.max(F.when(win, 1).otherwise(0)).over(W.partitionBy("make")))

    def top(df: DataFrame, kind: str, n: int, *order: Column) -> DataFrame:
        ranked = df.withColumn("rank", F.row_number().over(W.partitionBy("make").orderBy(*order, F.asc("intended"))))
        return ranked.filter(F.col("rank") <= n).select("make", F.lit(kind).alias("kind"), "rank", "intended")

    wins = top(c.filter(win), "win", 5, F.desc("share"), F.desc("coverage"))
    promising = top(c.filter((F.col("_any") == 0) & (F.col("positive") > 0)), "promising", 4, F.desc("positive"), F.desc("coverage"))
    gaps = top(c.filter((F.col("coverage") == 0) | ((total > 0) & (F.col("negative") > F.col("positive")))), "gap", 5, F.asc("coverage"), F.desc("negative"))
    return wins.unionByName(promising).unionByName(gaps)


def pullthrough_review(intended: DataFrame, mentions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Per review: intended items found, by synonym group or substring, of all intended for its make."""
    m, i = _clean(mentions, "make", "review"), _clean(intended, "make").distinct()
    pairs = semantic_match(m, i.withColumnRenamed("item", "intended"), synonyms, ["make"], "item", "intended")
    total = i.groupBy("make").agg(F.count("*").alias("total"))
    found = m.join(pairs, ["make", "item"]).groupBy("make", "review").agg(F.count_distinct("intended").alias("found"))
    out = m.select("make", "review").distinct().join(total, "make").join(found, ["make", "review"], "left").fillna(0, ["found"])
    return out.withColumn("rate", F.round(100.0 * F.col("found") / F.col("total"), 4))


# Drivers that reviews call by another name, and what these names hold.
DRIVER_NAMES = [("driver", "price/deal", "affordability"), ("driver", "exterior styling", "design")]


def pullthrough_kinds(intended: DataFrame, said: DataFrame, reviews: DataFrame | None, synonyms: DataFrame) -> DataFrame:
    """intended(make, kind, item), said(make, review, kind, item), reviews(make, review), synonyms(kind, group, term) -> make, review, kind, total, found, rate.

    Items of all kinds are matched at once, as distinct labels of make and kind: one holds the other, both hold a term of one group of their kind,
    or a driver's other name is said. The kind `overall` has the mean of the three rates, where a kind without intended items counts 0.
    Without reviews, those of said count, also where they say nothing. Pairs of labels are written once, so that their number says how they meet
    what is said; while they are sent, all of a review is counted where one shuffle by make and review has put it.
    """
    k, pair = ["make", "kind"], ["make", "kind", "item", "intended"]
    i, labels = _clean(intended, *k).distinct().withColumnRenamed("item", "intended"), _clean(said, *k).distinct()
    labels = kept(labels, "labels")
    grouped = lambda df, c: df.join(df.select("kind", c).distinct().join(synonyms, "kind").filter(F.contains(c, "term")).select("kind", c, "group").distinct(), ["kind", c])
    by_group = grouped(labels, "item").join(grouped(i, "intended"), [*k, "group"])
    names = said.sparkSession.createDataFrame(DRIVER_NAMES, "kind string, intended string, term string")
    by_name = i.join(F.broadcast(names), ["kind", "intended"]).join(labels, k).filter(F.contains("item", "term"))
    pairs = kept(reduce(DataFrame.unionByName, (df.select(*pair) for df in (substring_all_matches(labels, i, k, "item", "intended"), by_group, by_name))).distinct(), "pairs")
    s = said.select("make", "review", "kind", F.lower(F.trim("item")).alias("item"))
    if reviews is not None:
        none = F.lit(None).cast("string")
        s = s.unionByName(reviews.select("make", "review", none.alias("kind"), none.alias("item")))
    met = s.join(pairs.hint("broadcast" if pairs.count() <= SENT else "merge"), [*k, "item"], "left").select("make", "review", "kind", "intended").distinct()
    counts = met.groupBy("make", "review").agg(*(F.count_if((F.col("kind") == kind) & F.col("intended").isNotNull()).alias(f"_found_{kind}") for kind in KINDS))
    totals = i.groupBy("make").agg(*(F.count_if(F.col("kind") == kind).alias(f"_total_{kind}") for kind in KINDS))  # one row per make
    rows = counts.join(F.broadcast(totals), "make", "left").fillna(0)
    of = [(kind, F.col(f"_total_{kind}"), F.col(f"_found_{kind}")) for kind in KINDS]
    rate = lambda total, found: F.when(total > 0, 100.0 * found / total).otherwise(0.0)
    add = lambda x: reduce(Column.__add__, x)
    overall = (F.lit("overall"), add([t for _, t, _ in of]), add([f for _, _, f in of]), F.round(add([rate(t, f) for _, t, f in of]) / len(of), 4))
    each = F.array(*(F.struct(kind.alias("kind"), total.alias("total"), found.alias("found"), r.alias("rate")) for kind, total, found, r in [*((F.lit(n), t, f, F.round(rate(t, f), 4)) for n, t, f in of), overall]))
    return rows.select("make", "review", F.explode(each).alias("x")).select("make", "review", "x.*")


def pullthrough_portfolio(features: DataFrame, attributes: DataFrame, said_features: DataFrame, said_attributes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per make: features by substring, attributes exactly, and the share of positive reviews; each review counts once."""
    hit = substring_all_matches(said_features, features.withColumnRenamed("item", "intended"), ["make"], "item", "intended").select("make", F.col("intended").alias("item")).distinct().withColumn("_hit", F.lit(1))
    share = F.round(100.0 * F.coalesce(F.sum("_hit"), F.lit(0)) / F.count("*"), 4)
    f = _clean(features, "make").distinct().join(hit, ["make", "item"], "left").groupBy("make").agg(share.alias("features_pct"))
    said = _clean(said_attributes, "make").distinct().withColumn("_hit", F.lit(1))
    a = _clean(attributes, "make").distinct().join(said, ["make", "item"], "left").groupBy("make").agg(share.alias("attributes_pct"))
    r = reviews.groupBy("make").agg(F.count("*").alias("reviews"), F.round(100.0 * F.count_if(F.col("sentiment") == "positive") / F.count("*"), 4).alias("sentiment_pct"))
    return f.join(a, "make", "left").join(r, "make", "left")


def gap_analysis(coverage: DataFrame, n: int = 10, least: float = 50.0) -> DataFrame:
    """The largest gaps (100 less coverage) above a limit."""
    gap = coverage.withColumn("gap_score", F.round(100.0 - F.col("coverage"), 4)).filter(F.col("gap_score") > least)
    return gap.orderBy(F.desc("gap_score"), "make", "intended").limit(n).select("make", "intended", "gap_score")


def monthly_sentiment(reviews: DataFrame) -> DataFrame:
    """Mean per month of positive 1, neutral and unknown 0.5, negative 0."""
    score = F.when(F.col("sentiment") == "positive", 1.0).when(F.col("sentiment") == "negative", 0.0).otherwise(0.5)
    return reviews.filter("published_date IS NOT NULL").groupBy(F.trunc("published_date", "month").alias("month")).agg(F.round(F.avg(score), 4).alias("score"))


def monthly_pullthrough(rates: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean rate per month, a column per model; the given models keep the pivot from a pass over the data."""
    return rates.groupBy(F.trunc("published_date", "month").alias("month")).pivot("make", list(models)).agg(F.round(F.avg("rate"), 4))


def outlet_and_trend(rates: DataFrame, n: int = 5) -> DataFrame:
    """Per make the outlet of the best mean rate, and whether the last n rates exceed the first n on average."""
    best = rates.groupBy("make", "outlet_id").agg(F.avg("rate").alias("mean")).groupBy("make").agg(F.min_by("outlet_id", F.struct(-F.round("mean", 6), "outlet_id")).alias("best_outlet"))
    up, down = W.partitionBy("make").orderBy("published_date", "review"), W.partitionBy("make").orderBy(F.desc("published_date"), F.desc("review"))
    ends = rates.withColumns({"_i": F.row_number().over(up), "_j": F.row_number().over(down)})
    trend = ends.groupBy("make").agg(F.avg(F.when(F.col("_i") <= n, F.col("rate"))).alias("_first"), F.avg(F.when(F.col("_j") <= n, F.col("rate"))).alias("_last"))
    return best.join(trend, "make").select("make", "best_outlet", F.when(F.col("_last") > F.col("_first"), "improving").when(F.col("_last") < F.col("_first"), "declining").otherwise("stable").alias("trend"))
