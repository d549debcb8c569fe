"""Documents without a fixed schema, as VARIANT: walks of any depth, social URLs, and the sentiment export (SF-34, SF-35)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch

# Fields of a sentiment document that an export keeps.
EXPORTED = [
    "sentiment_classification", "key_features_mentioned", "brand_attributes_captured", "purchase_drivers", "competitive_context", "trim_level_mentioned", "trim_impact_score",
    "trim_highlights", "vehicle_identifier", "content_type", "overall_sentiment", "relevance_score", "summary", "brand_alignment",
]
# URLs of posts, by platform.
SOCIAL = {
    "Instagram": r"https?://(?:www\.)?instagram\.com/[a-zA-Z0-9_.]+/",
    "TikTok": r"https?://(?:www\.)?tiktok\.com/@[\w.]+/video/[\d]+",
    "YouTube": r"https?://(?:www\.)?youtube\.com/watch\?v=[\w-]+",
    "Twitter": r"https?://(?:www\.)?twitter\.com/[a-zA-Z0-9_]+/status/[\d]+",
    "Facebook": r"https?://(?:www\.)?facebook\.com/[a-zA-Z0-9.]+/posts/[\d]+",
}
# Hosts by which a post's platform is named, in order.
PLATFORMS = {"instagram.com": "Instagram", "tiktok.com": "TikTok", "youtube.com": "YouTube", "twitter.com": "Twitter", "facebook.com": "Facebook"}


def json_nodes(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """Every node of each JSON text: keys, path, depth, kind (object, array, string, number, boolean, null) and value (null for containers).

    Members are named .member and elements [position] below the root $. A text that is no JSON has no nodes. Each level of
    nesting is one pass over the containers of the level above, kept as a table in the shared folder, so a walk takes as many passes
    as the deepest document has levels and holds no document's nodes together. The texts are dealt over all tasks first, as a small file may
    hold many; a container is told by its children and its text is never made.
    """
    spark = df.sparkSession
    kept = [f"k{i}" for i in range(len(keys))]
    names = ", ".join(kept)
    dealt = df.select(*(F.col(k).alias(n) for k, n in zip(keys, kept)), F.col(col).alias("text")).repartition(*kept, "text")
    level = dealt.select(*kept, F.lit("$").alias("path"), F.lit(0).alias("depth"), F.try_parse_json("text").alias("node")).filter("node IS NOT NULL")
    found = None
    while True:
        held = F.when(F.try_variant_get("node", "$", "array<variant>").isNotNull(), "array").when(F.try_variant_get("node", "$", "map<string,variant>").isNotNull(), "object")
        mark = F.substring(F.to_json("node"), 1, 1)
        kind = held.when(mark == '"', "string").when(mark.isin("t", "f"), "boolean").when(F.is_variant_null("node"), "null").otherwise("number")
        place = scratch(spark, "nodes")
        level.withColumn("kind", kind).write.parquet(place)
        level = spark.read.parquet(place)
        scalar = F.when(~F.col("kind").isin("object", "array"), F.try_variant_get("node", "$", "string"))
        rows = level.select(*(F.col(n).alias(k) for k, n in zip(keys, kept)), "path", "depth", "kind", scalar.alias("value"))
        found = rows if found is None else found.unionByName(rows)
        inner = level.filter(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            return found
        level = spark.sql(
            f"""SELECT {names}, concat(path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path, depth + 1 AS depth, e.value AS node
                FROM {{inner}}, LATERAL variant_explode(node) AS e""",
            inner=inner,
        )


def is_social_url(url: Column) -> Column:
    """Whether a URL begins as one of a post does."""
    return url.rlike("^(?:" + "|".join(SOCIAL.values()) + ")")


def post_platform(url: Column) -> Column:
    """The platform whose host a post's URL holds, else Unknown."""
    return F.coalesce(*(F.when(F.contains(url, F.lit(host)), name) for host, name in PLATFORMS.items()), F.lit("Unknown"))


def social_urls(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """Distinct URLs of posts among the strings of each JSON text, at any depth: keys, url, platform.

    Strings come out of the parser, so escaped slashes and letters need no care.
    """
    strings = json_nodes(df, col, keys).filter(F.col("kind") == "string").filter(is_social_url(F.col("value")))
    return strings.select(*keys, F.col("value").alias("url")).distinct().withColumn("platform", post_platform(F.col("url")))


def _placeholder(make: Column, model: Column) -> Column:
    """The document of a clip whose analysis failed."""
    none, text = F.array().cast("array<string>"), F.lit("")
    # The fields of the placeholder.
    return F.to_json(
        F.struct(
            F.struct(F.lit("neutral").alias("overall"), F.lit(0.0).alias("confidence"), F.lit("Analysis failed").alias("rationale")).alias("sentiment_classification"),
            none.alias("key_features_mentioned"), none.alias("brand_attributes_captured"), none.alias("purchase_drivers"),
            F.struct(none.alias("direct_comparisons"), text.alias("market_positioning")).alias("competitive_context"),
            F.lit(False).alias("trim_level_mentioned"), F.lit(0.0).alias("trim_impact_score"), F.lit(None).cast("string").alias("trim_highlights"),
            F.trim(F.concat(F.coalesce(make, text), F.lit(" "), F.coalesce(model, text))).alias("vehicle_identifier"), F.lit("Web Article").alias("content_type"),
            F.lit("neutral").alias("overall_sentiment"), F.lit(5).alias("relevance_score"), F.lit("Enhanced sentiment analysis failed for this clip").alias("summary"), F.lit(False).alias("brand_alignment"),
        ),
        {"ignoreNullFields": "false"},
    )


def exported_sentiment(df: DataFrame, col: str, make: Column, model: Column) -> DataFrame:
    """`exported`: the document with no other fields than EXPORTED, in their order; a placeholder where none of them is there or the text is no JSON object.

    `analysed` tells which it is. A field that is there as null stays as null.
    """
    node = F.try_parse_json(col)
    fields = [F.try_variant_get(node, f"$.{k}", "variant").alias(k) for k in EXPORTED]
    out = df.withColumn("analysed", reduce(lambda a, b: a | b, (f.isNotNull() for f in fields)))
    return out.withColumn("exported", F.when(F.col("analysed"), F.to_json(F.struct(*fields))).otherwise(_placeholder(make, model)))


def sentiment_fields(df: DataFrame, col: str = "sentiment_json") -> DataFrame:
    """Classification, confidence and rationale of a sentiment document as columns, and the lengths of its arrays, 0 where there is none."""
    node = F.try_parse_json(col)
    text = lambda p, kind="string": F.try_variant_get(node, p, kind)
    n = lambda p: F.coalesce(F.size(F.try_variant_get(node, p, "array<variant>")), F.lit(0))
    return df.withColumns({
        "sentiment_detailed": text("$.sentiment_classification.overall"), "sentiment_confidence": text("$.sentiment_classification.confidence", "double"), "sentiment_rationale": text("$.sentiment_classification.rationale"),
        "feature_mentions_count": n("$.key_features_mentioned"), "brand_attributes_count": n("$.brand_attributes_captured"), "purchase_drivers_count": n("$.purchase_drivers"),
    })
