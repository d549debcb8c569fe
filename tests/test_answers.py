"""Golden answers of a model, and feeds of both kinds."""

import json

import pytest

from presslight.functions import answers as A
from presslight.functions import pages as P
from pyspark.sql import functions as F


def parsed(spark, texts):
    df = A.parse_answers(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string"), "t").withColumn("answer", F.to_json("answer")).orderBy("id")
    return [(r["answer"] and json.loads(r["answer"]), r["how"], r["overall_score"], r["reject_reason"]) for r in df.collect()]


def test_repairs(spark):
    found = parsed(spark, [
        '```json\n{"a": [1, 2,], "overall_score": 7,}\n``` and {so on}', 'text {"a": "x\x01y"} text', '{"a": "say \\"hi\\""}', '{\\"a\\": 1}', '{"a": [{"b": 1}\n{"b": 2}]}', "```\n{}\n```", '[{"a": 1}]',
    ])
    assert found == [
        ({"a": [1, 2], "overall_score": 7}, "clean", 7.0, None), ({"a": "xy"}, "clean", 5.0, None), ({"a": 'say "hi"'}, "clean", 5.0, None), ({"a": 1}, "clean", 5.0, None), ({"a": [{"b": 1}, {"b": 2}]}, "commas", 5.0, None), ({}, "clean", 5.0, None), ({"a": 1}, "clean", 5.0, None),
    ]


@pytest.mark.parametrize("aspects, score", [
    ({"x": {"score": 7}, "y": {"score": 8}}, 8.0), ({"x": {"score": 6}, "y": {"score": 7}}, 6.0), ({"x": {"note": "n"}, "y": 3, "z": {"score": 9}}, 9.0), ({}, 5.0), ([{"score": 9}], 5.0), (None, 5.0), ({"x": {"score": "bad"}}, 5.0),
])
def test_missing_score_is_the_mean_of_the_aspects(spark, aspects, score):
    assert parsed(spark, [json.dumps({"aspects": aspects, "overall_score": None})])[0][2] == score


def test_fields_of_broken_answers(spark):
    whole, least = parsed(spark, [
        '{"relevance_score": 9, "overall_sentiment": "positive", "brand_alignment": false, "summary": "a \\"b\\" c", "pros": ["p", "q"], "aspects": {"performance": {"score": 9, "note": "fast"}, "value": {"score": 2, ', 'so "relevance_score" : 4 }',
    ])
    doc, how, score, _ = whole
    assert (how, score) == ("fields", 6.0)  # 9, 7, 7, 7, 2: 6.4
    assert (doc["relevance_score"], doc["overall_sentiment"], doc["brand_alignment"], doc["pros"], doc["cons"]) == (9, "positive", False, ["p", "q"], A.CONS)
    assert doc["aspects"]["performance"] == {"score": 9, "note": "fast"} and doc["aspects"]["technology"] == {"score": 7, "note": "Technology analysis completed"}
    assert least[1:3] == ("fields", 7.0) and least[0]["summary"] == A.SUMMARY and least[0]["brand_alignment"] is True


def test_rejects(spark):
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, "I can't say."), (4, '{"a": '), (5, '{"a": 1}'), (5, '{"a": 1}')], "id int, t string")
    good, bad = A.answers_and_rejects(df, "t")
    assert sorted(r["id"] for r in good.collect()) == [5, 5] and {r["id"]: r["reject_reason"] for r in bad.collect()} == {1: "empty", 2: "empty", 3: "no_object", 4: "broken"}


FEEDS = [
    (1, '﻿<?xml version="1.0"?><rss xmlns:m="http://m"><channel><title>Kona news</title><link>http://c</link><item><m:title>other</m:title><title><![CDATA[Kona & more]]></title><link>http://a/1</link></item><item><title>None</title><description>of the KONA</description><link>http://a/2</link></item><item><title>No</title></item></channel></rss>'),
    (2, '<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title type="html">Kona &lt;b&gt;</title><link rel="self" href="http://b/1"/><link href="http://b/2"/><content type="text">c</content></entry><entry><title>x</title><summary>a kona</summary></entry></feed>'),
    (3, '<rdf:RDF xmlns:rdf="http://r"><channel><title>t</title></channel><item><title>Kona</title><link>http://d</link></item></rdf:RDF>'),
    (4, "<rss><channel><item><title>Kona</title></item></channel>"), (5, "<html><body>Kona</body></html>"), (6, None), (7, "Kona"), (8, "<rss><channel></channel></rss>"),
]


def test_feeds(spark):
    feeds = spark.createDataFrame(FEEDS, "page_id int, xml string")
    found = sorted(tuple(r) for r in P.feed_items(feeds, "Kona").select("page_id", "kind", "position", "title", "link", "description").collect())
    assert found == [
        (1, "rss", 0, "Kona & more", "http://a/1", ""), (1, "rss", 1, "None", "http://a/2", "of the KONA"), (2, "atom", 0, "Kona <b>", "http://b/1", "c"), (2, "atom", 1, "x", None, "a kona"), (3, "rss", 0, "Kona", "http://d", ""),
    ]
    assert {r["page_id"]: r["reject_reason"] for r in P.feed_rejects(feeds).collect()} == {4: "broken", 5: "no_items", 6: "empty", 7: "broken", 8: "no_items"}


def test_a_feed_is_parsed_once(spark):
    feeds = spark.createDataFrame(FEEDS, "page_id int, xml string")
    for df in (P.feed_items(feeds, "Kona"), P.feed_rejects(feeds)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


def test_no_filter_parses_answers_again(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "none")], "id int, t string")
    for side in A.answers_and_rejects(df, "t"):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "parse_json" in line]
        assert side.count() == 1
