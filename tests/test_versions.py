"""Versioned tables: what readers see, failed writes, double delivery, restarts, expiry; silences with late rows and a restart."""

import json
from datetime import datetime, timedelta

import pytest

from presslight.sources.versions import Conflict, VersionedTables
from presslight.sources.writers import save_oem_documents, upsert_version
from presslight.streaming import streams as S
from pyspark.sql import functions as F


@pytest.fixture
def tables(spark, tmp_path):
    return VersionedTables(spark, f"file://{tmp_path}/t")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def kv(spark, *pairs):
    return spark.createDataFrame(pairs, "k int, v string")


def test_readers_keep_their_version(spark, tables):
    assert tables.versions() == [] and tables.manifest()["tables"] == {}
    tables.publish(lambda old: {"a": kv(spark, (1, "x"))})
    before = tables.read("a")
    upsert_version(tables, "a", kv(spark, (1, "y"), (2, "z")), ["k"])
    assert rows(before) == [(1, "x")] and rows(tables.read("a")) == [(1, "y"), (2, "z")] and rows(tables.read("a", 1)) == [(1, "x")]
    assert set(tables.read("a").inputFiles()).isdisjoint(before.inputFiles())
    with pytest.raises(LookupError):
        tables.read("a", 9)


def test_a_failed_write_changes_nothing(spark, tables):
    tables.publish(lambda old: {"a": kv(spark, (1, "x")), "b": kv(spark, (1, "x"))})
    broken = kv(spark, (1, "x")).withColumn("v", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        tables.publish(lambda old: {"a": kv(spark, (2, "new")), "b": broken})
    assert tables.versions() == [1] and rows(tables.read("a")) == rows(tables.read("b")) == [(1, "x")]
    assert any(n.startswith("data/a-") for n in tables.expire(keep=1)) and rows(tables.read("a")) == [(1, "x")]  # the folder of the failed write


def test_two_writers_do_not_both_win(spark, tables):
    tables.publish(lambda old: {"a": kv(spark, (1, "x"))})

    def slow(old):
        tables.publish(lambda o: {"a": kv(spark, (1, "first"))})
        return {"a": kv(spark, (1, "second"))}

    with pytest.raises(Conflict):
        tables.publish(slow)
    assert tables.versions() == [1, 2] and rows(tables.read("a")) == [(1, "first")]


def test_double_delivery_and_expiry(spark, tables):
    add = lambda n, epoch: upsert_version(tables, "c", spark.createDataFrame([(1, n)], "k int, n long"), ["k"], ["n"], epoch)
    assert [add(5, 0), add(2, 1), add(2, 1), add(5, 0), add(1, 2)] == [1, 2, 2, 2, 3]
    assert rows(tables.read("c")) == [(1, 8)] and tables.manifest()["epoch"] == 2
    tables.expire(keep=2)
    assert tables.versions() == [2, 3] and rows(tables.read("c", 2)) == [(1, 7)]
    tables.publish(lambda old: {"other": kv(spark)})
    assert tables.manifest()["epoch"] == 2 and rows(tables.read("c")) == [(1, 8)] and rows(tables.read("other")) == []


def test_attempts_over_a_restart(spark, tables, tmp_path):
    source = f"{tmp_path}/in"

    def log(*entries):
        spark.createDataFrame([(w, r, datetime(2024, 1, d)) for w, r, d in entries], "wo_number long, result string, at timestamp").coalesce(1).write.mode("append").parquet(source)

    def run():
        S.stream_attempts(spark.readStream.schema("wo_number long, result string, at timestamp").parquet(source), tables, "tracking", f"{tmp_path}/state").awaitTermination()
        return {r["wo_number"]: (r["status"], r["attempt_count"], str(r["retry_after"])) for r in tables.read("tracking").collect()}

    log((1, "no_content", 1), (1, "timeout", 3), (2, "success", 2))
    assert run() == {1: ("searching", 2, "2024-01-04"), 2: ("found", 1, "None")}
    assert run() == {1: ("searching", 2, "2024-01-04"), 2: ("found", 1, "None")}  # nothing new
    log((1, "success", 5), (3, "blocked_403", 5))
    expected = {1: ("found", 3, "None"), 2: ("found", 1, "None"), 3: ("searching", 1, "2024-01-07")}
    assert run() == expected
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the query had died after publishing, before its commit: the last batch comes again
    for crc in (tmp_path / "state" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    assert run() == expected


def document(spark, features, attributes, model="m"):
    return spark.createDataFrame(
        [("id", "make", model, 2024, "p", "t", [{"feature": f} for f in features], attributes, [{"reason": "r", "priority": 1}])],
        "model_id string, make string, model string, year int, positioning_statement string, target_audience string, key_features_intended array<struct<feature: string, category: string, priority: string>>,"
        "brand_attributes_intended array<string>, purchase_drivers_intended array<struct<reason: string, priority: int>>",
    )


def test_documents_are_saved_as_one(spark, tables):
    save_oem_documents(tables, document(spark, ["a", "b"], ["x"]))
    save_oem_documents(tables, document(spark, ["c"], [], model="new").withColumn("target_audience", F.lit(None).cast("string")))
    assert rows(tables.read("models")) == [("id", "make", "new", 2024, "p", "t")]
    assert rows(tables.read("features")) == [("id", 1, "c", "", "primary", "", "positive")]
    assert rows(tables.read("attributes")) == [] and rows(tables.read("drivers")) == [("id", 1, "r", 1, "")]
    with pytest.raises(Exception, match="gone"):
        save_oem_documents(tables, document(spark, ["d"], ["y"]).withColumn("purchase_drivers_intended", F.when(F.raise_error(F.lit("gone")).isNull(), F.col("purchase_drivers_intended"))))
    assert rows(tables.read("features")) == [("id", 1, "c", "", "primary", "", "positive")] and tables.versions() == [1, 2]


def test_silences_with_late_rows_and_a_restart(spark, tmp_path):
    source, at = f"{tmp_path}/in", lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = "event_id long, ts timestamp, worker_id long, level string"

    def beats(*entries):
        spark.createDataFrame([(0, at(m), w, "INFO") for w, m in entries], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        with S.keyed_state(spark):
            out = S.stream_silences(spark.readStream.schema(schema).parquet(source), timedelta(minutes=30))
            out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        found = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
        return sorted((r["worker_id"], (r["last_seen"] - at(0)).total_seconds() / 60, (r["stale_at"] - r["last_seen"]).total_seconds() / 60) for r in found)

    beats((1, 0), (1, 20), (1, 100), (1, 95), (1, 300), (2, 5), (3, 299), (4, 270))
    first = [(1, 20.0, 30.0), (1, 100.0, 30.0), (2, 5.0, 30.0)]
    assert run() == first  # the watermark stands at 290: worker 4 may yet be heard
    beats((4, 292), (3, 310), (1, 331), (5, 400))
    assert run() == sorted([*first, (1, 300.0, 30.0), (1, 331.0, 30.0), (3, 310.0, 30.0), (4, 292.0, 30.0)])  # a gap of 30 minutes is none; 300 to 331 is
    assert json.dumps(spark.conf.get("spark.sql.streaming.stateStore.providerClass")).find("RocksDB") < 0
