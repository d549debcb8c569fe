"""Golden cases of documents without a fixed schema."""

import json

from presslight.functions import documents as D
from pyspark.sql import functions as F


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, j string")


def test_nodes_at_any_depth(spark):
    deep = "1"
    for i in range(12):
        deep = f'[{deep}]' if i % 2 else f'{{"a b": {deep}}}'
    found = D.json_nodes(frame(spark, [deep, '{"x": [null, true, "s", 2.5, {}, []]}', "{broken", None, '"alone"']), "j", ["id"]).collect()
    paths = {(r["id"], r["path"]): (r["depth"], r["kind"], r["value"]) for r in found}
    assert len(paths) == len(found)
    assert paths[0, "$[0].a b" + "[0].a b" * 5] == (12, "number", "1")
    assert [paths[1, f"$.x[{i}]"][1:] for i in range(6)] == [("null", None), ("boolean", "true"), ("string", "s"), ("number", "2.5"), ("object", None), ("array", None)]
    assert paths[4, "$"] == (0, "string", "alone") and {i for i, _ in paths} == {0, 1, 4}


def test_keys_may_clash_with_the_walks_own_columns(spark):
    df = spark.createDataFrame([(1, "p", '{"a": 1}')], "node int, `k0` string, j string")
    assert sorted(map(tuple, D.json_nodes(df, "j", ["node", "k0"]).collect())) == [(1, "p", "$", 0, "object", None), (1, "p", "$.a", 1, "number", "1")]


def test_social_urls(spark):
    good = {
        "https://www.instagram.com/some.one_1/reel/x": "Instagram", "https://tiktok.com/@a.b/video/12?x=1": "TikTok", "http://www.youtube.com/watch?v=a-B_1": "YouTube",
        "https://twitter.com/a_1/status/9": "Twitter", "https://facebook.com/a.b/posts/7": "Facebook",
    }
    bad = ["https://instagram.com/", "https://youtube.com/shorts/x", "ftp://twitter.com/a/status/1", "see https://twitter.com/a/status/1", "https://x.com/a/status/1", "https://tiktok.com/@a/photo/1"]
    text = json.dumps({"a": [*good, {"b": [bad, list(good)]}], "c": {"d": bad}}).replace("/", "\\/").replace("twitter.com", "twitt\\u0065r.com", 1)
    found = D.social_urls(frame(spark, [text, None, "[]"]), "j", ["id"]).collect()
    assert {(r["id"], r["url"], r["platform"]) for r in found} == {(0, u, p) for u, p in good.items()} and len(found) == len(good)
    assert spark.createDataFrame([("https://a.org",)], "u string").select(D.post_platform(F.col("u"))).first()[0] == "Unknown"


def test_export_keeps_known_fields_or_gives_the_placeholder(spark):
    whole = '{"summary": "s", "brand_alignment": null, "private": {"x": 1}, "purchase_drivers": [{"reason": "r"}]}'
    rows = D.exported_sentiment(frame(spark, [whole, '{"private": 1}', "{}", "[1]", "nonsense", None]), "j", F.lit("Make"), F.lit(None)).orderBy("id").collect()
    assert json.loads(rows[0]["exported"]) == {"purchase_drivers": [{"reason": "r"}], "summary": "s", "brand_alignment": None} and rows[0]["analysed"]
    for r in rows[1:]:
        doc = json.loads(r["exported"])
        assert not r["analysed"] and list(doc) == D.EXPORTED and doc["vehicle_identifier"] == "Make" and doc["trim_highlights"] is None and doc["relevance_score"] == 5


def test_fields_of_a_sentiment_document(spark):
    rows = D.sentiment_fields(frame(spark, ['{"sentiment_classification": {"overall": "positive", "confidence": 0.5}, "key_features_mentioned": [1, {"a": 2}], "purchase_drivers": null}', '{"key_features_mentioned": "no list"}', None]), "j").orderBy("id").collect()
    assert tuple(rows[0][2:]) == ("positive", 0.5, None, 2, 0, 0) and tuple(rows[1][2:]) == tuple(rows[2][2:]) == (None, None, None, 0, 0, 0)


def test_texts_of_one_partition_are_dealt(spark):
    texts = spark.range(0, 20000, 1, 1).select("id", F.concat(F.lit('{"a": "'), F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512), F.lit('"}')).alias("j"))
    nodes = D.json_nodes(texts, "j", ["id"])
    assert nodes.count() == 40000 and len(nodes.inputFiles()) > 2  # of two levels
