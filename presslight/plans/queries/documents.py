"""Queries over documents without a fixed schema (SF-34, SF-35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import answers as An
from ...functions import documents as D
from ..registry import query

K = ["wo_number", "url_pos", "part_id", "price"]
k = ", ".join(K)

#: By relevance: a whole document with a field that no export keeps, one without any known field, a broken text, none.
_DOCUMENT = """CASE relevance % 4 WHEN 0 THEN concat('{"summary": null, "secret": 1, "sentiment_classification": {"confidence": ', CAST(url_pos AS STRING), ', "overall": "', sentiment, '"}, "key_features_mentioned": ["', model, '", {"feature": "', trim, '"}]}')
    WHEN 1 THEN concat('{"other": "', model, '"}') WHEN 2 THEN concat('{"summary": "', model) END"""
_PLACEHOLDER = """concat('{"sentiment_classification":{"overall":"neutral","confidence":0.0,"rationale":"Analysis failed"},"key_features_mentioned":[],"brand_attributes_captured":[],"purchase_drivers":[],"competitive_context":{"direct_comparisons":[],"market_positioning":""},"trim_level_mentioned":false,"trim_impact_score":0.0,"trim_highlights":null,"vehicle_identifier":"', make, ' ', model, '","content_type":"Web Article","overall_sentiment":"neutral","relevance_score":5,"summary":"Enhanced sentiment analysis failed for this clip","brand_alignment":false}')"""

query(
    "SF-34", "b_cand",
    sql=f"""SELECT {k}, CASE WHEN relevance % 4 = 0 THEN sentiment END AS sentiment_detailed, CASE WHEN relevance % 4 = 0 THEN url_pos::DOUBLE END AS sentiment_confidence, CAST(NULL AS STRING) AS sentiment_rationale,
    CASE WHEN relevance % 4 = 0 THEN 2 ELSE 0 END AS feature_mentions_count, 0 AS brand_attributes_count, 0 AS purchase_drivers_count FROM b_cand""",
)(
    lambda c: D.sentiment_fields(c.withColumn("sentiment_json", F.expr(_DOCUMENT))).select(*K, "sentiment_detailed", "sentiment_confidence", "sentiment_rationale", "feature_mentions_count", "brand_attributes_count", "purchase_drivers_count")
)
query(
    "SF-34b", "b_cand",
    sql=f"""SELECT {k}, relevance % 4 = 0 AS analysed, CASE WHEN relevance % 4 = 0 THEN concat('{{"sentiment_classification":{{"confidence":', CAST(url_pos AS STRING), ',"overall":"', sentiment, '"}},"key_features_mentioned":["', model, '",{{"feature":"', trim, '"}}],"summary":null}}') ELSE {_PLACEHOLDER} END AS exported FROM b_cand""",
)(lambda c: D.exported_sentiment(c.withColumn("j", F.expr(_DOCUMENT)), "j", F.col("make"), F.col("model")).select(*K, "analysed", "exported"))

#: A captured page state for each part: posts at several depths with escaped slashes, page links, and what is no post.
_STATE = r"""concat('{"data":{"posts":[{"node":{"contentUrl":"https:\\/\\/www.instagram.com\\/', replace(p_name, ' ', '_'), '\\/p\\/', CAST(p_partkey AS STRING), '"},"likes":', CAST(p_size AS STRING), '},',
    '{"media":[{"items":["https://youtube.com/watch?v=', CAST(p_partkey AS STRING), '",null,5,"see https://youtube.com/watch?v=x"]}]}],"next":"https://example.com/', CAST(p_partkey AS STRING), '"},',
    '"again":"https://youtube.com/watch?v=', CAST(p_partkey AS STRING), '","draft":', CASE WHEN p_size % 2 = 0 THEN concat('"https:\\/\\/twitter.com\\/', lower(p_type), '\\/status\\/', CAST(p_size AS STRING), '"') ELSE '"https:\\/\\/twitter.com\\/home"' END, CASE WHEN p_size % 7 = 0 THEN '' ELSE '}' END)"""
_DUCK_STATE = _STATE.replace("\\\\", "\\")
_TREE = "FROM (SELECT p_partkey, {doc} AS j FROM part) AS p, json_tree(CASE WHEN json_valid(j) THEN j END) AS t"
query(
    "SF-35", "part",
    sql=f"""SELECT DISTINCT p_partkey, t.atom AS url, CASE WHEN contains(t.atom, 'instagram.com') THEN 'Instagram' WHEN contains(t.atom, 'youtube.com') THEN 'YouTube' ELSE 'Twitter' END AS platform
    FROM (SELECT p_partkey, json_extract_string(x.atom, '$') AS atom, x.type {_TREE.format(doc=_DUCK_STATE).replace('AS t', 'AS x')}) AS t
    WHERE t.type = 'VARCHAR' AND regexp_matches(t.atom, '^https?://(www\\.)?(instagram\\.com/[a-zA-Z0-9_.]+/|youtube\\.com/watch\\?v=[\\w-]+|twitter\\.com/[a-zA-Z0-9_]+/status/\\d+)')""".replace("\\\\.", "\\.").replace("\\\\?", "\\?").replace("\\\\w", "\\w").replace("\\\\d", "\\d"),
)(lambda p: D.social_urls(p.withColumn("j", F.expr(_STATE)), "j", ["p_partkey"]))
query(
    "SF-35b", "events",
    sql="""SELECT event_id, CASE WHEN t.parent IS NULL THEN '$' ELSE concat('$.', t.key) END AS path, CASE WHEN t.parent IS NULL THEN 0 ELSE 1 END AS depth, CASE t.type WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind, CASE WHEN t.type <> 'OBJECT' THEN CAST(t.atom AS STRING) END AS value
    FROM events, json_tree(props) AS t""",
)(lambda e: D.json_nodes(e, "props", ["event_id"]))

#: By relevance: a fenced answer without a score, one amid other text, one without commas between objects, one broken off, none.
_ANSWER = """CASE relevance % 6 WHEN 0 THEN concat('Sure! ```json\n{"name": "', model, '", "aspects": {"value": {"score": ', CAST(url_pos AS STRING), '}, "design": {"score": ', CAST(url_pos + 1 AS STRING), ',}, "other": 1},}\n``` Done {x}')
    WHEN 1 THEN concat('Here: {"relevance_score": 3, "summary": "say \\\\"', model, '\\\\"", "overall_score": ', CAST(url_pos AS STRING), '} and more')
    WHEN 2 THEN concat('{"aspects": [], "list": [{"x": 1} {"x": 2}], "name": "', model, '"}')
    WHEN 3 THEN concat('{"relevance_score": ', CAST(url_pos AS STRING), ', "pros": ["', model, '", "quiet"], "aspects": {"performance": {"score": 1, "note": "fast"}, "value": {"score": 2')
    WHEN 4 THEN concat('{"name": "', model) ELSE concat('no answer for ', model) END"""
query(
    "SF-32b", "b_cand",
    sql=f"""SELECT {k}, CASE relevance % 6 WHEN 0 THEN 'clean' WHEN 1 THEN 'clean' WHEN 2 THEN 'commas' WHEN 3 THEN 'fields' END AS how, CASE relevance % 6 WHEN 4 THEN 'broken' WHEN 5 THEN 'no_object' END AS reject_reason,
    CASE relevance % 6 WHEN 0 THEN round_even(url_pos + 0.5, 0)::DOUBLE WHEN 1 THEN url_pos::DOUBLE WHEN 2 THEN 5.0 WHEN 3 THEN 5.0 END AS overall_score,
    CASE relevance % 6 WHEN 0 THEN model WHEN 2 THEN model END AS name, CASE relevance % 6 WHEN 1 THEN 3 WHEN 3 THEN url_pos END AS relevance_score, CASE relevance % 6 WHEN 1 THEN concat('say "', model, '"') WHEN 3 THEN 'Comprehensive analysis completed using enhanced parsing techniques.' END AS summary,
    CASE WHEN relevance % 6 = 3 THEN model END AS first_pro, CASE WHEN relevance % 6 = 3 THEN 'fast' END AS note FROM b_cand""",
)(
    lambda c: An.parse_answers(c.select(*K, F.expr(_ANSWER).alias("text")), "text").select(
        *K, "how", "reject_reason", "overall_score", *(F.try_variant_get("answer", p, t).alias(n) for n, p, t in (("name", "$.name", "string"), ("relevance_score", "$.relevance_score", "int"), ("summary", "$.summary", "string"), ("first_pro", "$.pros[0]", "string"), ("note", "$.aspects.performance.note", "string")))
    )
)
query("SF-32c", "b_cand", sql="SELECT CASE WHEN relevance % 6 < 4 THEN 'answer' WHEN relevance % 6 = 4 THEN 'broken' ELSE 'no_object' END AS side, count(*) AS n FROM b_cand GROUP BY 1")(
    lambda c: (lambda good, bad: good.select(F.lit("answer").alias("side")).unionByName(bad.select(F.col("reject_reason").alias("side"))).groupBy("side").agg(F.count("*").alias("n")))(*An.answers_and_rejects(c.select(*K, F.expr(_ANSWER).alias("text")), "text"))
)
