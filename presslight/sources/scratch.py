"""A place that driver and executors share, for tables written between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or below a temporary folder where that is unset and all run on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="presslight-")
    return f"{base.rstrip('/')}/presslight/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read from there."""
    df.write.parquet(place := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(place)
