"""The polled monitoring queries as Structured Streaming jobs over the event stream (SS).

Late data: the watermark is 10 minutes; later rows are dropped by windows in append mode. Every
function takes a streaming (or, for the first three, also a batch) frame with event_id, ts, worker_id, level.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import apply_attempts
from ..sources.scratch import scratch
from ..sources.versions import VersionedTables

WATERMARK = "10 minutes"


def _marked(events: DataFrame) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", WATERMARK) if events.isStreaming else events


def stream_throughput(events: DataFrame, unit: str = "1 minute") -> DataFrame:
    """Events and errors per tumbling window."""
    return _marked(events).groupBy(F.window("ts", unit)).agg(F.count("*").alias("events"), F.count_if(F.col("level") == "ERROR").alias("errors")).select(F.col("window.start").alias("slot"), "events", "errors")


def stream_activity(events: DataFrame, size: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Activity per sliding window, with a verdict."""
    by = _marked(events).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("events"))
    return by.select(F.col("window.end").alias("window_end"), "events", F.when(F.col("events") >= 2, "active").otherwise("idle").alias("verdict"))


def stream_bursts(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Sessions of each worker that a gap ends."""
    by = _marked(events).groupBy(F.session_window("ts", gap).alias("session"), "worker_id").agg(F.count("*").alias("events"))
    return by.select("worker_id", F.col("session.start").alias("started"), F.col("session.end").alias("ended"), "events")


def stream_stale(heartbeats: DataFrame, as_of: str, timeout: str = "24 hours") -> DataFrame:
    """Each worker's last heartbeat and whether it is too old by as_of (update or complete mode)."""
    by = heartbeats.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("worker_id").agg(F.max("ts").alias("last_seen"))
    return by.withColumn("stale", F.col("last_seen") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {timeout}"))


def stream_attempts(attempts: DataFrame, tables: VersionedTables, name: str, checkpoint: str):
    """Starts a query that publishes each batch of attempts(wo_number, result, at) as the next version of the tracking table.

    Count, last attempt, status and the date of the next try are kept by work order (see apply_attempts). A batch that is delivered again after a restart
    is known by its number in the manifest and changes nothing; each batch reads the newest version only.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        empty = batch.sparkSession.createDataFrame([], "wo_number long, status string, last_attempt_date timestamp, attempt_count long, retry_after date")
        tables.publish(lambda old: {name: apply_attempts(old(name) or empty, batch)}, epoch)

    return attempts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Silence(StatefulProcessor):
    """Per key the runs of heartbeats that no silence parts, as their first and last times; the run's end plus the time-out is a timer."""

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "runs array<struct<first: long, last: long>>")

    def _keep(self, runs: list[tuple[int, int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not runs:
            self.runs.clear()
            return
        self.runs.update((runs,))
        self.handle.registerTimer(-(-(min(last for _, last in runs) + self.timeout_us) // 1000))

    def _held(self) -> list[tuple[int, int]]:
        return [(r[0], r[1]) for r in self.runs.get()[0]] if self.runs.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs = self._held()
        for pdf in rows:
            runs += [(t, t) for t in np.unique(pdf["us"].to_numpy(np.int64)).tolist()]
            merged: list[tuple[int, int]] = []
            for first, last in sorted(runs):
                if merged and first - merged[-1][1] <= self.timeout_us:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], last))
                else:
                    merged.append((first, last))
            runs = merged
        self._keep(runs)
        yield pd.DataFrame({"worker_id": [], "last_us": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # later runs of the key may have ended too
        runs = self._held()
        done = [last for _, last in runs if last + self.timeout_us <= now]
        self._keep([r for r in runs if r[1] + self.timeout_us > now])
        yield pd.DataFrame({"worker_id": [key[0]] * len(done), "last_us": done})

    def close(self) -> None:
        pass


def stream_silences(heartbeats: DataFrame, timeout: timedelta) -> DataFrame:
    """One event for each silence: a worker without a heartbeat for longer than the time-out, as soon as the watermark has passed its end.

    Returns worker_id, last_seen, stale_at. Heartbeats may come in any order within the watermark. A key's state is its open runs of heartbeats, and it ends with the last of them.
    """
    us = timeout // timedelta(microseconds=1)
    rows = _marked(heartbeats).select("worker_id", "ts", F.unix_micros("ts").alias("us"))
    found = rows.groupBy("worker_id").transformWithStateInPandas(_Silence(us), "worker_id long, last_us long", outputMode="Append", timeMode="EventTime")
    return found.select("worker_id", F.timestamp_micros("last_us").alias("last_seen"), F.timestamp_micros(F.col("last_us") + us).alias("stale_at"))


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def stream_first_by_key(events: DataFrame, k: str) -> DataFrame:
    """The first event of each key, as long as repeats come within the watermark."""
    return _marked(events).dropDuplicatesWithinWatermark([k]) if events.isStreaming else events.dropDuplicates([k])


def stream_error_alerts(logs: DataFrame, workers: DataFrame) -> DataFrame:
    """Errors as they come, with their worker's row."""
    return logs.filter(F.col("level").isin("ERROR", "CRITICAL")).join(workers, "worker_id")


def latest_epoch(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """The rows of the newest folder epoch=N of path (before a given epoch), as storage has it; after a restart too."""
    kept = spark.read.schema(schema).option("basePath", path).parquet(path).withColumn("epoch", F.regexp_extract("_metadata.file_path", r"epoch=(-?\d+)/", 1).cast("long"))
    kept = kept if before is None else kept.filter(F.col("epoch") < before)
    return kept.join(F.broadcast(kept.agg(F.max("epoch").alias("epoch"))), "epoch", "left_semi").drop("epoch")  # one row


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All a stream gives for the data that is there, as a table: a run with trigger availableNow into files; in complete mode each epoch's whole result."""
    spark: SparkSession = stream.sparkSession
    folder = scratch(spark, "stream")
    out = stream.writeStream.option("checkpointLocation", folder + "/state").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", folder + "/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(folder + "/out")
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/epoch=-1")  # for a stream without data
    out.outputMode(mode).foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")).start().awaitTermination()
    return latest_epoch(spark, folder + "/out", stream.schema)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of one file, under the names of the log."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, for a stream's path may be a file only so
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "CRITICAL").when(F.col("event_type") == "click", "WARNING").otherwise("INFO")
    return raw.select("event_id", "ts", F.col("user_id").alias("worker_id"), level.alias("level"))
