"""Queries over sentiment documents and intended messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import sentiment as S
from ..registry import query
from .joined import _SYN


def _documents(c):
    """A sentiment document for each work order, from its candidates."""
    x = c.select(
        "wo_number", "make", F.col("published").alias("published_date"), "sentiment",
        F.struct(F.col("model").alias("feature"), "sentiment", F.col("line_status").alias("quote")).alias("f"),
        F.struct(F.col("trim").alias("attribute"), F.when(F.col("flag") == "A", "reinforced").when(F.col("flag") == "N", "neutral").otherwise("challenged").alias("sentiment"), F.col("flag").alias("evidence")).alias("a"),
        F.struct(F.split_part("model", F.lit(" "), F.lit(2)).alias("reason"), "sentiment", F.when(F.col("url_pos") <= 2, "primary").otherwise("secondary").alias("strength"), F.col("flag").alias("quote")).alias("d"),
        F.concat("make", F.lit(": better")).alias("r"),
    )
    by = x.groupBy("make", "wo_number").agg(F.min("published_date").alias("published_date"), F.min("sentiment").alias("s"), F.collect_list(F.struct(*"fadr")).alias("_x"))
    by = by.select("*", *(F.col(f"_x.{k}").alias(k) for k in "fadr"))
    doc = F.struct(
        F.struct(F.col("s").alias("overall")).alias("sentiment_classification"), F.col("f").alias("key_features_mentioned"), F.col("a").alias("brand_attributes_captured"), F.col("d").alias("purchase_drivers"),
        F.struct(F.col("r").alias("direct_comparisons")).alias("competitive_context"),
    )
    return by.select("wo_number", "make", "published_date", F.to_json(doc).alias("sentiment_json"))


query("AG-02", "b_cand", sql="SELECT feature, count(*) AS total, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative, string_agg(DISTINCT quote, '|' ORDER BY quote) AS quotes FROM b_feature WHERE make = 'Brand#3' GROUP BY 1")(
    lambda c: S.aggregate_features(_documents(c), make="Brand#3")
)
query("AG-03", "b_cand", sql="SELECT trim AS attribute, count(*) AS total, count(*) FILTER (flag = 'A') AS reinforced, count(*) FILTER (flag = 'N') AS neutral, count(*) FILTER (flag = 'R') AS challenged, string_agg(DISTINCT flag, '|' ORDER BY flag) AS quotes FROM b_cand GROUP BY 1")(
    lambda c: S.aggregate_attributes(_documents(c))
)
query("AG-04", "b_cand", sql="SELECT split_part(model, ' ', 2) AS reason, count(*) AS total, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (url_pos <= 2) AS primary, count(*) FILTER (url_pos > 2) AS secondary, string_agg(DISTINCT flag, '|' ORDER BY flag) AS quotes FROM b_cand GROUP BY 1")(
    lambda c: S.aggregate_drivers(_documents(c))
)
query(
    "AG-05", "b_cand",
    sql="""WITH c AS (SELECT * FROM b_cand WHERE make = 'Brand#3') SELECT 'sentiment' AS section, s AS item, count(*) AS n FROM (SELECT min(sentiment) AS s FROM c GROUP BY wo_number) GROUP BY 2
    UNION ALL (SELECT 'feature', model, count(*) FROM c GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL (SELECT 'attribute', trim, count(*) FROM c GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
    UNION ALL (SELECT 'driver', split_part(model, ' ', 2), count(*) FROM c GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL SELECT 'competitor', make, count(*) FROM c GROUP BY 2""",
)(lambda c: S.vehicle_summary(_documents(c), make="Brand#3"))
query(
    "AG-13", "part",
    sql="""WITH f AS (SELECT p_brand AS b, to_json(list({'item': p_name, 'size': p_size} ORDER BY p_partkey)) AS j FROM part WHERE p_name IS NOT NULL GROUP BY 1), m AS (SELECT DISTINCT p_brand AS b FROM part)
    SELECT m.b AS model_id, concat('{"make":"', m.b, '","features":', coalesce(j, '[]'), '}') AS document FROM m LEFT JOIN f ON m.b = f.b""",
)(
    lambda p: S.oem_document(
        p.select(F.col("p_brand").alias("model_id"), F.col("p_brand").alias("make")).distinct(),
        features=p.filter("p_name IS NOT NULL").select(F.col("p_brand").alias("model_id"), F.col("p_partkey").alias("position"), F.col("p_name").alias("item"), F.col("p_size").alias("size")),
    )
)


def _said(c):
    r = c.select("make", F.col("wo_number").alias("review"), "sentiment", "flag", "model", "trim", "published", "outlet_id", "relevance", "price")
    return r


def _features(c):
    return _said(c).filter("relevance >= 6").select("make", "review", "sentiment", F.col("model").alias("item"))


def _attributes(c):
    return _said(c).filter("relevance >= 9").select("make", "review", F.when(F.col("flag") == "A", "reinforced").otherwise("neutral").alias("sentiment"), F.col("trim").alias("item"))


def _intended(p):
    """Intended features and attributes by make."""
    make = F.col("p_brand").alias("make")
    return (
        p.select(make, F.split_part("p_name", F.lit(" "), F.lit(2)).alias("item")).distinct(),
        p.filter("p_type IN ('PROMO', 'LARGE')").select(make, F.col("p_type").alias("item")).distinct(),
    )


_HIT = "(contains({0}, {1}) OR contains({1}, {0}))"
_COVER = f"""r AS (SELECT make, count(DISTINCT wo_number) AS n_reviews FROM b_cand GROUP BY 1),
    m AS (SELECT c.make, wo_number, sentiment, lower(model) AS item, (SELECT min(lower(feature)) FROM b_intent i WHERE i.make = c.make AND {_HIT.format('lower(model)', 'lower(feature)')}) AS intended FROM b_cand c WHERE relevance >= 6),
    cov AS (SELECT i.make, lower(feature) AS intended, n_reviews, count(DISTINCT wo_number) AS reviews, count(wo_number) AS mentions, count(*) FILTER (sentiment = 'positive') AS positive,
    count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative, round(100.0 * count(DISTINCT wo_number) / n_reviews, 4)::DOUBLE AS coverage
    FROM b_intent i JOIN r ON i.make = r.make LEFT JOIN m ON m.make = i.make AND m.intended = lower(i.feature) GROUP BY 1, 2, 3)"""


def _coverage(c, p):
    return S.feature_coverage(_intended(p)[0], _features(c), _said(c))


query("AG-15", "b_cand", "part", sql=f"WITH {_COVER} SELECT make, intended, reviews, mentions, positive, neutral, negative, n_reviews, coverage FROM cov")(_coverage)
_STATE = "CASE flag WHEN 'A' THEN 'reinforced' WHEN 'N' THEN 'neutral' ELSE 'challenged' END"


def _reviewed(c):
    """What each candidate says, as a row of its work order's review."""
    x = lambda item, sentiment: F.array(F.struct(item.alias("item"), sentiment.alias("sentiment")))
    said = {"features": x(F.col("model"), F.col("sentiment")), "attributes": x(F.col("trim"), F.expr(_STATE)), "drivers": x(F.split_part("model", F.lit(" "), F.lit(1)), F.col("sentiment"))}
    return c.select("make", F.col("wo_number").alias("review"), "sentiment", *(items.alias(name) for name, items in said.items()))


query(
    "AG-14", "b_cand", "part",
    sql=f"""WITH i AS (SELECT p_brand AS make, 'feature' AS kind, lower(split_part(p_name, ' ', 2)) AS item, min(p_partkey) AS pos FROM part GROUP BY ALL UNION ALL SELECT p_brand, 'attribute', lower(p_type), min(p_partkey) FROM part GROUP BY ALL
      UNION ALL SELECT p_brand, 'driver', lower(split_part(p_name, ' ', 1)), min(p_partkey) FROM part GROUP BY ALL),
    s AS (SELECT make, wo_number AS review, 'feature' AS kind, lower(model) AS item, sentiment FROM b_cand UNION ALL SELECT make, wo_number, 'attribute', lower(trim), {_STATE} FROM b_cand UNION ALL SELECT make, wo_number, 'driver', lower(split_part(model, ' ', 1)), sentiment FROM b_cand),
    l AS (SELECT DISTINCT make, kind, item FROM s),
    p AS (SELECT * FROM (SELECT l.make, l.kind, l.item, i.item AS intended, row_number() OVER (PARTITION BY l.make, l.kind, l.item ORDER BY i.pos, i.item) AS rn FROM l JOIN i ON i.make = l.make AND i.kind = l.kind WHERE {_HIT.format('l.item', 'i.item')}) WHERE kind = 'attribute' OR rn = 1),
    h AS (SELECT s.make, s.kind, p.intended, count(DISTINCT review) AS reviews, count(*) AS mentions, count(*) FILTER (sentiment IN ('positive', 'reinforced')) AS good FROM s JOIN p ON p.make = s.make AND p.kind = s.kind AND p.item = s.item GROUP BY ALL),
    r AS (SELECT make, count(*) AS n_reviews, round(100.0 * count(*) FILTER (sentiment = 'positive') / count(*), 4)::DOUBLE AS positive_pct, round(100.0 * count(*) FILTER (sentiment = 'neutral') / count(*), 4)::DOUBLE AS neutral_pct, round(100.0 * count(*) FILTER (sentiment = 'negative') / count(*), 4)::DOUBLE AS negative_pct
      FROM (SELECT make, wo_number, min(sentiment) AS sentiment FROM b_cand GROUP BY ALL) GROUP BY 1),
    m AS (SELECT i.make, coalesce(any_value(n_reviews), 0) AS n_reviews, coalesce(any_value(positive_pct), 0) AS positive_pct, coalesce(any_value(neutral_pct), 0) AS neutral_pct, coalesce(any_value(negative_pct), 0) AS negative_pct,
      coalesce(round(100.0 * count(*) FILTER (i.kind = 'feature' AND mentions > 0) / count(*) FILTER (i.kind = 'feature'), 4)::DOUBLE, 0) AS features_pct, coalesce(round(100.0 * count(*) FILTER (i.kind = 'feature' AND reviews >= greatest(floor(0.2 * n_reviews), 1)) / count(*) FILTER (i.kind = 'feature'), 4)::DOUBLE, 0) AS consistency_pct,
      coalesce(round(100.0 * count(*) FILTER (i.kind = 'attribute' AND good > 0) / count(*) FILTER (i.kind = 'attribute'), 4)::DOUBLE, 0) AS attributes_pct, coalesce(round(100.0 * count(*) FILTER (i.kind = 'driver' AND good > 0) / count(*) FILTER (i.kind = 'driver'), 4)::DOUBLE, 0) AS drivers_pct
      FROM i LEFT JOIN r ON r.make = i.make LEFT JOIN h ON h.make = i.make AND h.kind = i.kind AND h.intended = i.item GROUP BY 1)
    SELECT *, round((features_pct + attributes_pct + drivers_pct) / 3, 3) AS alignment_pct FROM m""",
)(
    lambda c, p: S.pullthrough_model(
        _of_kinds(p, [F.col("p_brand").alias("make"), F.col("p_partkey").alias("position")], F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_type"), F.split_part("p_name", F.lit(" "), F.lit(1))), _reviewed(c)
    )
)


def _few(p):
    return p.filter("p_type = 'ECONOMY'").select(F.col("p_brand").alias("make"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("item")).distinct()


query(
    "AG-16", "b_cand", "part",
    sql=f"""WITH i AS (SELECT DISTINCT p_brand AS make, lower(split_part(p_name, ' ', 2)) AS item FROM part WHERE p_type = 'ECONOMY'), e AS (SELECT make, lower(model) AS item, count(*) AS mentions FROM b_cand c WHERE relevance >= 6 AND NOT EXISTS (SELECT 1 FROM i WHERE i.make = c.make AND {_HIT.format('lower(c.model)', 'i.item')}) GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY make ORDER BY mentions DESC, item)::INTEGER AS rank FROM e) WHERE rank <= 10""",
)(lambda c, p: S.emergent_features(_few(p), _features(c)))
query(
    "AG-17", "b_cand", "part",
    sql=f"""WITH {_COVER}, t AS (SELECT *, positive + neutral + negative AS total, CASE WHEN positive + neutral + negative > 0 THEN positive / (positive + neutral + negative) ELSE 0 END AS share FROM cov),
    w AS (SELECT *, (coverage >= 5 AND share >= 0.34 AND total > 0) AS win FROM t), v AS (SELECT *, bool_or(win) OVER (PARTITION BY make) AS has FROM w)
    SELECT make, 'win' AS kind, rank, intended FROM (SELECT *, row_number() OVER (PARTITION BY make ORDER BY share DESC, coverage DESC, intended)::INTEGER AS rank FROM v WHERE win) WHERE rank <= 5
    UNION ALL SELECT make, 'promising', rank, intended FROM (SELECT *, row_number() OVER (PARTITION BY make ORDER BY positive DESC, coverage DESC, intended)::INTEGER AS rank FROM v WHERE NOT has AND positive > 0) WHERE rank <= 4
    UNION ALL SELECT make, 'gap', rank, intended FROM (SELECT *, row_number() OVER (PARTITION BY make ORDER BY coverage, negative DESC, intended)::INTEGER AS rank FROM v WHERE coverage = 0 OR (total > 0 AND negative > positive)) WHERE rank <= 5""",
)(lambda c, p: S.wins_and_gaps(_coverage(c, p), 5.0, 0.34))
query(
    "AG-18", "b_cand", "part",
    sql=f"""WITH syn(g, t) AS (VALUES {', '.join(str(x) for x in _SYN)}), i AS (SELECT DISTINCT p_brand AS make, lower(split_part(p_name, ' ', 2)) AS item FROM part WHERE p_type = 'ECONOMY'), tot AS (SELECT make, count(*) AS total FROM i GROUP BY 1),
    mm AS (SELECT DISTINCT make, lower(model) AS item FROM b_cand WHERE relevance >= 6), p AS (SELECT mm.make, mm.item, i.item AS intended FROM mm JOIN i ON mm.make = i.make WHERE {_HIT.format('mm.item', 'i.item')} OR EXISTS (SELECT 1 FROM syn a, syn b WHERE a.g = b.g AND contains(mm.item, a.t) AND contains(i.item, b.t)))
    SELECT c.make, wo_number AS review, total, count(DISTINCT intended) AS found, round(100.0 * count(DISTINCT intended) / total, 4)::DOUBLE AS rate FROM b_cand c JOIN tot ON c.make = tot.make LEFT JOIN p ON p.make = c.make AND p.item = lower(c.model) WHERE relevance >= 6 GROUP BY 1, 2, 3""",
)(lambda c, p: S.pullthrough_review(_few(p), _features(c), c.sparkSession.createDataFrame(_SYN, "group string, term string")))


def _of_kinds(df, key, feature, attribute, driver):
    """A row for each kind of item."""
    items = F.array(*(F.struct(F.lit(kind).alias("kind"), item.alias("item")) for kind, item in zip(S.KINDS, (feature, attribute, driver))))
    return df.select(*key, F.explode(items).alias("x")).select("*", "x.kind", "x.item").drop("x")


_KIND_SYN = [("feature", g, t) for g, t in _SYN]
_SAID_DRIVER = "CASE flag WHEN 'A' THEN 'great affordability' WHEN 'N' THEN 'Comfort and space' ELSE 'bold design' END"
_MEANT_DRIVER = "CASE p_size % 4 WHEN 0 THEN 'price/deal' WHEN 1 THEN 'exterior styling' WHEN 2 THEN 'comfort' ELSE 'safety' END"
query(
    "AG-18b", "b_cand", "part",
    sql=f"""WITH syn(kind, g, t) AS (VALUES {', '.join(str(x) for x in _KIND_SYN)}), nm(intended, term) AS (VALUES ('price/deal', 'affordability'), ('exterior styling', 'design')),
    i AS (SELECT DISTINCT p_brand AS make, 'feature' AS kind, lower(split_part(p_name, ' ', 2)) AS item FROM part UNION SELECT DISTINCT p_brand, 'attribute', lower(p_type) FROM part UNION SELECT DISTINCT p_brand, 'driver', {_MEANT_DRIVER} FROM part),
    s AS (SELECT DISTINCT make, wo_number AS review, 'feature' AS kind, lower(model) AS item FROM b_cand UNION SELECT DISTINCT make, wo_number, 'attribute', lower(trim) FROM b_cand UNION SELECT DISTINCT make, wo_number, 'driver', lower({_SAID_DRIVER}) FROM b_cand),
    l AS (SELECT DISTINCT make, kind, item FROM s),
    p AS (SELECT l.make, l.kind, l.item, i.item AS intended FROM l JOIN i ON l.make = i.make AND l.kind = i.kind WHERE contains(l.item, i.item) OR contains(i.item, l.item)
       OR EXISTS (SELECT 1 FROM syn a, syn b WHERE a.g = b.g AND a.kind = l.kind AND b.kind = l.kind AND contains(l.item, a.t) AND contains(i.item, b.t))
       OR EXISTS (SELECT 1 FROM nm WHERE l.kind = 'driver' AND nm.intended = i.item AND contains(l.item, nm.term))),
    f AS (SELECT s.make, s.review, s.kind, count(DISTINCT intended) AS found FROM s JOIN p ON p.make = s.make AND p.kind = s.kind AND p.item = s.item GROUP BY ALL),
    t AS (SELECT make, kind, count(*) AS total FROM i GROUP BY ALL),
    r AS (SELECT c.make, c.review, k.kind, coalesce(t.total, 0) AS total, coalesce(f.found, 0) AS found FROM (SELECT DISTINCT make, wo_number AS review FROM b_cand) c CROSS JOIN (VALUES ('feature'), ('attribute'), ('driver')) k(kind)
      LEFT JOIN t ON t.make = c.make AND t.kind = k.kind LEFT JOIN f ON f.make = c.make AND f.review = c.review AND f.kind = k.kind)
    SELECT make, review, coalesce(kind, 'overall') AS kind, sum(total)::BIGINT AS total, sum(found)::BIGINT AS found, round(avg(CASE WHEN total > 0 THEN 100.0 * found / total ELSE 0 END), 4)::DOUBLE AS rate FROM r GROUP BY GROUPING SETS ((make, review, kind), (make, review))""",
)(
    lambda c, p: S.pullthrough_kinds(
        _of_kinds(p, [F.col("p_brand").alias("make")], F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_type"), F.expr(_MEANT_DRIVER)),
        # all of a review is brought together before it becomes a row for each kind
        _of_kinds(c.repartition("make", "wo_number"), ["make", F.col("wo_number").alias("review")], F.col("model"), F.col("trim"), F.expr(_SAID_DRIVER)),
        None, c.sparkSession.createDataFrame(_KIND_SYN, "kind string, group string, term string"),
    )
)
query(
    "AG-19", "b_cand", "part",
    sql=f"""WITH i AS (SELECT DISTINCT p_brand AS make, lower(split_part(p_name, ' ', 2)) AS item FROM part), ia AS (SELECT DISTINCT p_brand AS make, lower(p_type) AS item FROM part WHERE p_type IN ('PROMO', 'LARGE'))
    SELECT f.make, features_pct, attributes_pct, reviews, sentiment_pct FROM (SELECT make, round(100.0 * count(*) FILTER (EXISTS (SELECT 1 FROM b_cand c WHERE c.make = i.make AND relevance >= 6 AND {_HIT.format('lower(c.model)', 'i.item')})) / count(*), 4)::DOUBLE AS features_pct FROM i GROUP BY 1) f
    LEFT JOIN (SELECT make, round(100.0 * count(*) FILTER (EXISTS (SELECT 1 FROM b_cand c WHERE c.make = ia.make AND relevance >= 9 AND lower(c.trim) = ia.item)) / count(*), 4)::DOUBLE AS attributes_pct FROM ia GROUP BY 1) a ON f.make = a.make
    LEFT JOIN (SELECT make, count(*) AS reviews, round(100.0 * count(*) FILTER (sentiment = 'positive') / count(*), 4)::DOUBLE AS sentiment_pct FROM b_clip GROUP BY 1) r ON f.make = r.make""",
)(lambda c, p: S.pullthrough_portfolio(_intended(p)[0], _intended(p)[1], _features(c), _attributes(c), _REVIEWS(c)))
query("AG-20", "b_cand", "part", sql=f"WITH {_COVER} SELECT make, intended, round(100.0 - coverage, 4) AS gap_score FROM cov WHERE round(100.0 - coverage, 4) > 50 ORDER BY gap_score DESC, make, intended LIMIT 10")(lambda c, p: S.gap_analysis(_coverage(c, p)))


def _REVIEWS(c):
    from ...operators.windows import best_clip

    return best_clip(c).select("make", F.col("wo_number").alias("review"), "sentiment", F.col("published").alias("published_date"))


query("AG-21", "b_clip", sql="SELECT CAST(date_trunc('month', published_date) AS DATE) AS month, round(avg(CASE sentiment WHEN 'positive' THEN 1.0 WHEN 'negative' THEN 0.0 ELSE 0.5 END), 4) AS score FROM b_clip WHERE published_date IS NOT NULL GROUP BY 1")(S.monthly_sentiment)
_RATES = "SELECT make, wo_number AS review, outlet_id, published_date, relevance * 10.0 AS rate FROM b_clip WHERE make IS NOT NULL"


def _rates(c):
    return c.filter("make IS NOT NULL").select("make", F.col("wo_number").alias("review"), "outlet_id", "published_date", (F.col("relevance") * 10.0).cast("double").alias("rate"))


query("AG-22", "b_clip", sql=f"SELECT CAST(date_trunc('month', published_date) AS DATE) AS month, round(avg(rate) FILTER (make = 'Brand#1'), 4) AS \"Brand#1\", round(avg(rate) FILTER (make = 'Brand#2'), 4) AS \"Brand#2\" FROM ({_RATES}) GROUP BY 1")(
    lambda c: S.monthly_pullthrough(_rates(c), ["Brand#1", "Brand#2"])
)
query(
    "AG-23", "b_clip",
    sql=f"""WITH r AS ({_RATES}), b AS (SELECT make, outlet_id FROM (SELECT make, outlet_id, row_number() OVER (PARTITION BY make ORDER BY round(avg(rate), 6) DESC, outlet_id) AS rn FROM r GROUP BY 1, 2) WHERE rn = 1),
    e AS (SELECT *, row_number() OVER (PARTITION BY make ORDER BY published_date, review) AS i, row_number() OVER (PARTITION BY make ORDER BY published_date DESC, review DESC) AS j FROM r),
    t AS (SELECT make, avg(rate) FILTER (i <= 5) AS f, avg(rate) FILTER (j <= 5) AS l FROM e GROUP BY 1)
    SELECT b.make, outlet_id AS best_outlet, CASE WHEN l > f THEN 'improving' WHEN l < f THEN 'declining' ELSE 'stable' END AS trend FROM b JOIN t ON b.make = t.make""",
)(lambda c: S.outlet_and_trend(_rates(c)))
