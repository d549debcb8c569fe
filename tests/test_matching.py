"""Names in texts by the index, against every pair and golden names."""

import random

import pytest

from presslight.operators import matching as M
from pyspark.sql import functions as F


def test_index_loses_no_pair(spark):
    rng = random.Random(1)
    letters = ["a", "b", "c", "é", "-", " ", "1", "."]
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(25)))) for i in range(150)] + [(150, None), (150, ""), (151, "ABCABC"), (151, "ABCABC"), (152, "x" * 50_000 + "abca" * 3)]
    terms = {"".join(rng.choices(letters, k=rng.randrange(1, 8))) for _ in range(120)} | {"abcab", "--", "a", ".", ""}
    found = M.texts_with(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t, "x") for t in terms], "term string, role string")).select("id", "term")
    expected = sorted((i, t) for i, text in texts if text is not None for t in terms if t and t in text.lower())
    assert sorted(map(tuple, found.collect())) == expected
    none = spark.createDataFrame([], "term string, role string")
    assert M.texts_with(spark.createDataFrame(texts, "id int, text string"), none).count() == 0


@pytest.mark.parametrize("name, some", [
    ("CX-50", {"cx-50", "cx50", "cx 50"}), ("Model 3", {"model 3", "model3", "model-3", "mode-l 3"}), ("GTR T-Spec", {"gtr t-spec", "gt-r t-spec", "gtr tspec", "gtr-t-spec", "gtr t spec"}),
    ("F150", {"f150", "f 150"}), ("Emira Spec", {"emira special", "amir spec", "amera spec", "emiraspec"}), ("Perf", {"performance", "per-f"}), ("", set()),
])
def test_spellings(spark, name, some):
    found = set(spark.createDataFrame([(name,)], "n string").select(F.explode(M.spellings(F.col("n")))).toPandas().iloc[:, 0])
    assert some <= found and "" not in found and (name == "") == (not found)


@pytest.mark.parametrize("model, base, trim", [("Camry XLE V6", "camry", ["xle", "v6"]), ("F-150 Raptor", "f-150 raptor", ["f-150", "raptor"]), ("Model S Plaid", "model", ["s", "plaid"]), ("Crown Signia", "crown signia", []), ("GT", "gt", ["gt"])])
def test_components(spark, model, base, trim):
    b, t = M.components(F.col("m"))
    assert tuple(spark.createDataFrame([(model,)], "m string").select(b, t).first()) == (base, trim)


def test_vehicles_of_a_text(spark):
    vehicles = spark.createDataFrame([("A", "CX-50"), ("A", "Crown Signia"), ("A", "Corona Sport V6"), ("A", "Corona"), ("B", "CX-50"), ("A", None)], "make string, model string")
    docs = spark.createDataFrame([(1, "A", "The CX50 turbo"), (2, "A", "my Corona is old"), (3, "A", "a corona in Sport dress"), (4, "A", "signia of the crown"), (5, "B", "cx 50, corona"), (6, None, "cx 50"), (7, "A", None), (1, "A", "The CX50 turbo")], "doc_id int, make string, text string")
    found = lambda t: sorted(map(tuple, M.fuzzy_model_match(docs, vehicles, t).collect()))
    sure = [(1, "A", "CX-50"), (2, "A", "Corona"), (3, "A", "Corona"), (3, "A", "Corona Sport V6"), (5, "B", "CX-50")]
    assert found(0.6) == sure and found(0.5) == sorted([*sure, (2, "A", "Corona Sport V6")])


def test_makes_by_other_names(spark):
    makes = spark.createDataFrame([("Volkswagen",), ("Rolls-Royce",), ("Tin",), (None,)], "make string")
    docs = spark.createDataFrame([(1, "the V.W. of a friend"), (2, "a ROLLS"), (3, "nothing of it, Martin"), (4, None)], "doc_id int, text string")
    assert sorted(map(tuple, M.makes_named(docs, makes).collect())) == [(1, "Volkswagen"), (2, "Rolls-Royce"), (3, "Tin")]


def test_texts_stay_where_they_are(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('Brand', id % 3) AS make", "concat('the hot bolt ', id) AS text")
    vehicles = spark.createDataFrame([(f"Brand{i}", m) for i in range(3) for m in ("Hot Bolt", "Cold Ring")], "make string, model string")
    found = M.fuzzy_model_match(docs, vehicles)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # texts are dealt once, before their grams are made, and only terms are sent to every task
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("BroadcastExchange") == 2 and "SortMergeJoin" not in plan
    assert "BuildLeft" not in M.makes_named(docs, vehicles.select("make"))._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(M, "SENT", 0)  # more terms than are sent: the same rows by shuffles
    apart = M.fuzzy_model_match(docs, vehicles)
    assert "BroadcastHashJoin" not in apart._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, apart.collect())) == rows and len(rows) == 2000


def test_index_takes_any_characters(spark):
    rng = random.Random(2)
    letters = ["a", "ß", "]", "\\", "^", "&&", "[", "🚗", "\n", "\x00", "Σ"]
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(30)))) for i in range(200)]
    terms = {"".join(rng.choices(letters, k=rng.randrange(1, 9))).lower() for _ in range(150)} | {t[3:11].lower() for _, t in texts[:50]}
    low = dict(spark.createDataFrame(texts, "id int, text string").select("id", F.lower("text")).collect())
    found = M.texts_with(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")).select("id", "term")
    assert sorted(map(tuple, found.collect())) == sorted((i, t) for i, text in low.items() for t in terms if t and t in text)


def test_few_terms_share_a_gram(spark):
    names = spark.createDataFrame([(f"{a} bolt",) for a in ("red", "hot", "old", "new", "big")], "term string")
    assert M.index_of(names).groupBy("gram").count().agg(F.max("count")).first()[0] == 1
    vehicles = spark.createDataFrame([("A", f"Model {c} Sport") for c in "bcdfgh"], "make string, model string")
    assert M.model_terms(vehicles).filter("term = 'sport'").count() == 0  # of no use without its base


def test_rows_of_one_text(spark):
    vehicles = spark.createDataFrame([("A", "Corona Sport"), ("A", "Ring"), ("A", "Two  Rings")], "make string, model string")
    rows = [(1, "A", "a Corona"), (1, "A", "in SPORT dress"), (2, "A", "a corona"), (2, "B", "sport"), (3, "A", "sport"), (4, "A", "the Ring"), (4, "A", None)]
    docs = spark.createDataFrame(rows, "doc_id int, make string, text string")
    assert sorted(map(tuple, M.fuzzy_model_match(docs, vehicles).collect())) == [(1, "A", "Corona Sport"), (4, "A", "Ring")]
    spaced = spark.createDataFrame([(5, "A", "two  rings"), (6, "A", "two rings")], "doc_id int, make string, text string")
    assert sorted(map(tuple, M.fuzzy_model_match(spaced, vehicles.filter("model LIKE 'Two%'")).collect())) == [(5, "A", "Two  Rings"), (6, "A", "Two  Rings")]
    # without doc_id a text is its own, whatever others say
    alone = M.fuzzy_model_match(docs.drop("doc_id").union(spark.createDataFrame([("A", "the Ring"), ("A", "sport corona")], "make string, text string")), vehicles)
    assert sorted(map(tuple, alone.collect())) == [("sport corona", "A", "Corona Sport"), ("the Ring", "A", "Ring")]
