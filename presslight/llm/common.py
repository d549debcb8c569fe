"""Shared helpers: the shared scratch folder, written tables, and text columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="presslight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back.

    Cuts the lineage at a copy that outlives lost executors; Spark's commit protocol keeps
    retried tasks from leaving rows twice. The folder is scratch space and its owner clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/presslight/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Arrow batches of so many rows and bytes at most, so that a batch of very long texts fits into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_key(col: Column) -> Column:
    """A string for joins and hashes in which null differs from every value."""
    return F.when(col.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col.cast("string")))


def hex_long(digest: Column, digits: int = 15) -> Column:
    """The first hex digits of a digest as a non-negative long."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def fold_of(col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def apart(docs: DataFrame) -> DataFrame:
    """docs with `in:` before every name, so that no column added beside these clashes with one."""
    return docs.toDF(*(f"in:{c}" for c in docs.columns))


def given(name: str) -> Column:
    """A column of docs after apart(), by its name in docs."""
    quoted = name.replace("`", "``")
    return F.col(f"`in:{quoted}`").alias(name)
