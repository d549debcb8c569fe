"""Readers of loans, outlets, media sources, posts, sentiment documents and folders of JSON (SC)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings in the order they are tried; the last reads any bytes.
ENCODINGS = ("utf-8", "latin1", "iso-8859-1", "cp1252")
#: Names that Spark's readers don't take, and the one they take for the same letters.
READ_AS = {"latin1": "iso-8859-1", "cp1252": "iso-8859-1"}
# The columns of the feeds without a header, in order.
FEED_COLUMNS = ["ActivityID", "Person_ID", "Make", "Model", "WO #", "Office", "To", "Affiliation", "Start Date", "Stop Date", "Model Short Name", "Links"]
OUTLET_COLUMNS = ["Person_ID", "Reporter_Name", "Outlet_ID", "Outlet_Name", "Outlet_URL", "Impressions"]
MODEL_COLUMNS, URL_COLUMNS = ("Model Short Name", "Model"), ("Links", "Media Link", "WO Link")


def _strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def encoding_of(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """The first encoding in which every line of each file decodes; read by Spark, so any store will do and files are split."""
    lines = spark.read.text(path).select("value")  # the bytes of the files, not validated
    for e in encodings[:-1]:
        if e != "utf-8" or lines.filter(F.try_validate_utf8("value").isNull()).isEmpty():
            return e
    return encodings[-1]


def read_csv_any_encoding(spark: SparkSession, path: str, schema: T.StructType | None = None, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    found = encoding_of(spark, path, encodings)
    reader = spark.read.option("header", schema is None).option("encoding", READ_AS.get(found, found)).option("multiLine", True).option("escape", '"')
    return (reader if schema is None else reader.schema(schema)).csv(path)


def read_loans(spark: SparkSession, path: str) -> DataFrame:
    """Loans with a header: names trimmed, a byte order mark dropped; WO #, Make and a column of URLs are required.

    Gives wo_number, make, model, links and the other columns; short model names and Links come first.
    """
    raw = read_csv_any_encoding(spark, path)
    raw = raw.toDF(*(c.replace("﻿", "").strip() for c in raw.columns))
    urls, models = [c for c in URL_COLUMNS if c in raw.columns], [c for c in MODEL_COLUMNS if c in raw.columns]
    missing = [c for c in ("WO #", "Make") if c not in raw.columns] + ["a column of URLs"] * (not urls) + ["a model"] * (not models)
    if missing:
        raise ValueError(f"loans lack {', '.join(missing)}")
    blank = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    return raw.withColumns({"wo_number": F.regexp_replace(F.trim(F.col("`WO #`")), ",", ""), "make": F.trim("Make"), "model": F.coalesce(*map(blank, models)), "links": F.coalesce(*map(blank, urls))})


def read_loans_feed(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The headerless feed: its rows, and the lines that don't fit."""
    ddl = ", ".join(f"`{c}` string" for c in [*FEED_COLUMNS, "_corrupt"])
    lines = spark.read.text(path).filter("value <> ''").select("value", F.from_csv("value", ddl, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("_row"))
    good = lines.filter(F.col("_row._corrupt").isNull()).select(*(F.col(f"_row.`{c}`").alias(c) for c in FEED_COLUMNS))
    bad = lines.filter(F.col("_row._corrupt").isNotNull()).select(F.col("value").alias("line"), F.size(F.split("value", ",")).alias("fields"))
    return (good if limit is None else good.limit(limit)), bad


def read_outlets(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(_strings(OUTLET_COLUMNS)).csv(path)
    return raw.select(
        F.col("Person_ID").try_cast("long").alias("person_id"), F.col("Reporter_Name").alias("reporter_name"), F.col("Outlet_ID").try_cast("long").alias("outlet_id"), F.col("Outlet_Name").alias("outlet_name"),
        F.col("Outlet_URL").alias("outlet_url"), F.col("Impressions").try_cast("long").alias("impressions"),
    )


def read_media_sources(spark: SparkSession, path: str) -> DataFrame:
    """Active media sources; the domain lower-cased without www."""
    raw = read_csv_any_encoding(spark, path)
    return raw.withColumn("domain", F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "")).filter(F.lower(F.col("active")).isin("true", "1", "yes"))


def flatten_pages(df_json: DataFrame, path: str = "data.getPosts.edges") -> DataFrame:
    """A row for each node in the edges of each page."""
    return df_json.select(F.explode(path).alias("_edge")).select(F.col("_edge.node").alias("node"))


def read_sentiment_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def profile_json_files(spark: SparkSession, folder: str, keys: Sequence[str] = ("posts", "campaign", "data"), large: int = 100_000) -> DataFrame:
    """Size in bytes, kind and key hits of each JSON file of a folder, largest first."""
    raw = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", F.col("content").cast("string").alias("value"))
    kind = F.when(F.ltrim("value").startswith("["), "array").when(F.ltrim("value").startswith("{"), "object").otherwise("other")
    hits = F.array_compact(F.array(*(F.when(F.contains("value", F.lit(f'"{k}"')), k) for k in keys)))
    out = raw.select("file", F.col("length").alias("size"), kind.alias("kind"), F.array_join(hits, ",").alias("keys"), (F.col("length") >= large).alias("large"))
    return out.withColumn("candidate", (F.col("keys") != "") & (F.col("kind") != "other")).orderBy(F.desc("size"), "file")
