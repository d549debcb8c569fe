"""Mixing sources to target weights by weighted fair queueing, with native Spark functions only.

Every document enters once per allowed repeat. In a source the documents stand in a shuffled
order; the copy of a document in repeat e finishes at the virtual time
(e * source tokens + tokens of the source up to and with it) / source weight. All copies, over
all sources, are then sorted by finish time and cut where the running total reaches the budget.
A source whose copies run out stops at max_repeats times its size while the others go on, so the
cut falls at the water level of the targets.

Both running totals are prefix sums in two levels (per slice, then in the slice), so that no task
holds a whole source: a source is split by the shuffle key, the time line by the level it ends at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, apart, given, hex_long, id_key, text_or_empty

#: Rows of a slice, about; the least hex digits of the shuffle key that slice a source; the least slices of the time up to the
#: water level, and of each doubling beyond.
SLICE_ROWS, LEAST_DIGITS, TIME_SLICES = 1 << 20, 3, 2048
#: What the mix adds to the columns of documents.
ADDED = ("size", "source_size", "target", "copies", "taken")


def source_targets(sources: DataFrame, share: float = 1.0, max_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """source, source_size -> weight, target and level (the water level), one row per source.

    Sources in ascending code point order, null last, weigh 1, 2, .., cycle, repeating, unless the
    table brings a column `weight`. The budget is share times all sizes. A target stops at
    max_repeats times its source's size; the excess goes to the others by weight, until none is above.
    Works on one row per source.
    """
    if "weight" not in sources.columns:
        rn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
        sources = sources.withColumn("weight", (rn - 1) % F.lit(cycle) + 1)
    everything = W.partitionBy(F.lit(0))
    line = everything.orderBy("_ratio", F.col("source").asc_nulls_last())
    filled = (
        sources.withColumn("_cap", F.col("source_size") * max_repeats)
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("weight"))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("weight").over(line.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_before")) / F.col("_rest"))
        .withColumn("_full", F.col("_ratio") <= F.col("_level"))
        .withColumn("level", F.coalesce(F.min(F.when(~F.col("_full"), F.struct("_ratio", "_level"))).over(everything)["_level"], F.max("_ratio").over(everything), F.lit(0.0)))
    )
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return filled.select("source", "source_size", F.col("weight").cast("long").alias("weight"), target.alias("target"), "level", F.floor("_budget").cast("long").alias("budget"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.0, max_repeats: int = 3, cycle: int = 3, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, source, ..) with size, source_size, target, copies and taken.

    size: words of the text (null: 0); copies: how often the mix takes the document (0 to
    max_repeats); taken = copies * size. weights(source, weight) replaces the cycle of weights;
    sources it lacks weigh 0 and are not taken. A null source is a source of its own. Documents
    without words take no share of the budget and finish with the document before them; very long texts
    count in full. Repeated rows and equal ids are separate documents; rows equal in id and text are
    interchangeable. An empty table gives no rows. Columns of docs with one of the five names are
    replaced; all others pass through, whatever their names.
    The same table and seed give the same mix, however the rows are dealt out.
    """
    mixed = _mixed(docs, weights, share, max_repeats, cycle, seed)
    return mixed.select(*(given(c) for c in docs.columns if c.lower() not in ADDED), *ADDED)


def _mixed(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.0, max_repeats: int = 3, cycle: int = 3, seed: int = 7) -> DataFrame:
    """apart(docs) with the columns of the mix beside it."""
    rows = docs.count()
    digits = LEAST_DIGITS
    while 16**digits * SLICE_ROWS < rows:
        digits += 1
    time_slices = max(TIME_SLICES, max_repeats * rows // SLICE_ROWS)
    doc_id, text = F.col("doc_id"), F.col("text")
    named = apart(docs).withColumns({c: given(c) for c in ("doc_id", "text", "source")})
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text_or_empty()))
    sized = named.withColumns(
        {
            "size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
            "_key": key,
            "_source": id_key(F.col("source")),
        }
    ).drop("text")
    sized = sized.withColumn("_slice", hex_long(F.col("_key"), digits))

    # Per slice of a source: what comes before it, and all that is known of the source.
    slices = sized.groupBy("_source", "_slice").agg(F.sum("size").alias("_sum"), F.first("source").alias("source"))
    sources = slices.groupBy("_source").agg(F.sum("_sum").alias("source_size"), F.first("source").alias("source"))
    if weights is not None:
        asked = weights.groupBy(id_key(F.col("source")).alias("_source")).agg(F.sum(F.col("weight").cast("long")).alias("weight"))  # a source may be listed twice
        sources = sources.join(asked, "_source", "left").fillna({"weight": 0})
        live = sources.filter("weight > 0")
        idle = sources.filter("weight <= 0").select("source", "source_size", "weight", F.lit(0.0).alias("target"), F.lit(0.0).alias("level"), F.lit(0).cast("long").alias("budget"))
        targets = source_targets(live.drop("_source"), share, max_repeats, cycle).unionByName(idle)
    else:
        targets = source_targets(sources.drop("_source"), share, max_repeats, cycle)
    targets = targets.withColumn("_source", id_key(F.col("source"))).drop("source")
    before = W.partitionBy("_source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = slices.drop("source").withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").join(targets, "_source")

    in_slice = W.partitionBy("_source", "_slice").orderBy("_key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sized.withColumn("_in", F.sum("size").over(in_slice)).join(starts, ["_source", "_slice"]).withColumn("_at", F.col("_start") + F.col("_in"))

    # All copies on the time line, cut at the budget; narrow rows only.
    copies = (
        placed.filter("weight > 0")
        .select("_source", "_key", "size", "weight", "level", "budget", "source_size", "_at", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("_repeat"))
        .withColumn("_at", F.col("_at") + F.col("_repeat") * F.col("source_size"))
        .withColumn("_time", F.col("_at") / F.col("weight"))
        .withColumn("_tick", F.try_divide(F.col("_time"), F.col("level")))
        .withColumn("_tick", F.coalesce(F.floor(F.when(F.col("_tick") <= 1, F.col("_tick")).otherwise(1 + F.log2("_tick")) * time_slices), F.lit(0)))
    )
    ticks = copies.groupBy("_tick").agg(F.sum("size").alias("_sum"))
    ticks = ticks.withColumn("_done", F.coalesce(F.sum("_sum").over(W.partitionBy(F.lit(0)).orderBy("_tick").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    sorted_ = W.partitionBy("_tick").orderBy("_time", "_source", "_key", "_repeat").rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = (
        copies.join(ticks, "_tick")
        .filter(F.col("_done") < F.col("budget"))
        .withColumn("_total", F.col("_done") + F.sum("size").over(sorted_))
        .filter(F.col("_total") <= F.col("budget"))
        .groupBy("_source")
        .agg(F.max("_at").alias("_cut"))
    )
    # A source's copies are taken in order: it is cut at one place. The table is joined per slice, so a large source spreads.
    cuts = slices.select("_source", "_slice").join(kept, "_source", "left")
    taken = sum((F.when(F.col("_at") + e * F.col("source_size") <= F.col("_cut"), 1).otherwise(0) for e in range(max_repeats)), F.lit(0))
    return placed.join(cuts, ["_source", "_slice"]).withColumn("copies", taken.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs as they are, each document as many times as it was taken."""
    mixed = _mixed(docs, **options).filter("copies > 0")
    return mixed.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*(given(c) for c in docs.columns))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap,
             sum(source_size) OVER ()::BIGINT AS budget FROM s),
f AS (SELECT *, cap::DOUBLE / weight AS ratio,
             coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
             sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest FROM w),
l AS (SELECT *, (budget - before) / rest AS lv FROM f),
v AS (SELECT coalesce(arg_min(lv, ratio) FILTER (ratio > lv), 0) AS level FROM l),
t AS (SELECT source, source_size, weight, budget, CASE WHEN ratio <= lv THEN cap::DOUBLE ELSE weight * level END AS target FROM l, v),
p AS (SELECT d.*, source_size, weight, budget, target,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT p.*, (pos + e * source_size)::DOUBLE / weight AS time, e FROM p, (SELECT unnest([0, 1, 2]) AS e)),
r AS (SELECT *, sum(size) OVER (ORDER BY time, source NULLS FIRST, k, e ROWS UNBOUNDED PRECEDING) AS total FROM c)
SELECT doc_id, size, source_size, target, (count(*) FILTER (total <= budget) * size)::BIGINT AS taken
FROM r GROUP BY doc_id, k, source, size, source_size, target
"""
