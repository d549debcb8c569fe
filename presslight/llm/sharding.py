"""Sharding by minimax contiguous partition.

Equal texts form one atomic group. Groups stand in the order of a hash of their text; shards are
runs of groups in that order. The smallest capacity for which a greedy cut needs no more than the
wanted shards is found by binary search, and the groups are cut there (law `bytes`).

The binary search runs on a summary of the order: segments of the hash range with their bytes. A
greedy cut over segments that may be split anywhere bounds the capacity from below, one over
segments that may not be split bounds it from above. Only segments in which a cut can still fall
are split further, until these are single groups; then greedy cut and capacity are exact. So the
driver holds a few thousand sums however many groups there are, and no task sees more than its slice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart, given, hex_long, id_key, text_or_empty, written

HASH_BITS = 60
#: The first summary has 2**FIRST_BITS segments; each refinement splits a segment into 2**SPLIT_BITS.
FIRST_BITS, SPLIT_BITS = 12, 8


class _Line:
    """Segments in hash order: first hash, bytes, whether one group only."""

    def __init__(self, segments: list[tuple[int, int, int, bool]]):
        #: (first hash, bits of the segment's range, bytes, atomic)
        self.segments = sorted(segments)
        self.size = np.array([s[2] for s in self.segments], dtype=np.int64)
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.atomic = np.array([s[3] for s in self.segments], dtype=bool)
        self.total = int(self.ends[-1]) if len(self.ends) else 0

    def whole(self, capacity: int, shards: int) -> tuple[list[int], bool]:
        """Greedy cut before whole segments: the index at which each next shard starts, and whether all fits."""
        cuts, at = [], 0
        while len(cuts) < shards:
            nxt = int(np.searchsorted(self.ends, self.starts[at] + capacity, side="right"))
            if nxt >= len(self.ends):
                return cuts, True
            if nxt == at:
                break
            cuts.append(at := nxt)
        return cuts, False

    def fluid(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy cut that splits segments anywhere, but for single groups: the segment of each cut."""
        cuts, x = [], 0
        for _ in range(shards):
            y = x + capacity
            if y >= self.total:
                return cuts
            k = int(np.searchsorted(self.ends, y, side="right"))
            if self.atomic[k]:
                y = int(self.starts[k])
            if y <= x:
                return None
            cuts.append(k)
            x = y
        return None


def _smallest(fits, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """groups(h, bytes), one row per group -> first h of shards 1, 2, .., and the smallest capacity."""

    def segments(df: DataFrame, bits: int) -> list[tuple[int, int, int, bool]]:
        found = df.groupBy(F.shiftright("h", bits).alias("_segment")).agg(F.sum("bytes").alias("_bytes"), F.min("h").alias("_min"), F.max("h").alias("_max"))
        return [(r["_segment"] << bits, bits, r["_bytes"], r["_min"] == r["_max"]) for r in found.collect()]

    line = _Line(segments(groups, HASH_BITS - FIRST_BITS))
    while line.total:
        low = _smallest(lambda c: line.fluid(c, shards) is not None, -(-line.total // shards), line.total)
        high = _smallest(lambda c: line.whole(c, shards)[1], low, line.total)
        # Any exact greedy cut at a capacity in between falls between these two.
        (early, ended), late = line.whole(low, shards), line.fluid(high, shards)
        open_: set[int] = set()
        for j in range(shards - 1):
            if ended and j >= len(early):
                break
            first = early[min(j, len(early) - 1)] - 1 if early else 0
            last = late[j] if j < len(late) else len(line.segments) - 1
            open_.update(k for k in range(max(0, first), last + 1) if not line.atomic[k])
        if not open_:
            break
        if len(open_) > 4 * 2**FIRST_BITS >> SPLIT_BITS:
            # Far apart still: halve the work by splitting the largest ones first.
            open_ = set(sorted(open_, key=lambda k: -line.size[k])[: 4 * 2**FIRST_BITS >> SPLIT_BITS])
        kept = [s for k, s in enumerate(line.segments) if k not in open_]
        by_bits: dict[int, list[int]] = {}
        for k in open_:
            by_bits.setdefault(line.segments[k][1], []).append(line.segments[k][0])
        for bits, firsts in by_bits.items():
            kept += segments(groups.filter(F.shiftright("h", bits).isin([f >> bits for f in firsts])), max(0, bits - SPLIT_BITS))
        line = _Line(kept)
    if not line.total:
        return [], 0
    capacity = _smallest(lambda c: line.whole(c, shards)[1], -(-line.total // shards), line.total)
    return [line.segments[k][0] for k in line.whole(capacity, shards)[0]], capacity


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs(doc_id, text, ..) with size, text_crc32, law, shard, slot and grown_shard.

    size: UTF-8 bytes of the text plus 1. A null text counts as the empty one: equal to it, no bytes,
    crc32 0. Equal texts share a shard, so a shard holds at least the largest group. slot counts the
    rows of a shard from 0 without gaps, in an order that spreads large groups; repeated rows get a
    slot each, very long texts count in full. An empty table gives no rows. Columns of docs with these names
    are replaced; all others pass through, whatever their names.
    """
    own = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    bytes_ = text_or_empty("`in:text`").cast("binary")
    sized = apart(docs).withColumns(
        {"doc_id": given("doc_id"), "size": (F.octet_length(bytes_) + 1).cast("long"), "text_crc32": F.crc32(bytes_), "_h": hex_long(F.md5(bytes_))}
    )
    groups = written(sized.groupBy(F.col("_h").alias("h")).agg(F.sum("size").alias("bytes")), "shard-groups")
    cuts, _ = minimax_cuts(groups, shards)
    shard = sum((F.when(F.col("_h") >= cut, 1).otherwise(0) for cut in cuts), F.lit(0)).cast("int")

    # Slots: rows are counted per slice of a shard, and numbered in the slice from what comes before.
    row_key = F.md5(F.concat(id_key(F.col("doc_id")), F.lit("|"), F.col("_h").cast("string")))
    placed = sized.withColumns({"shard": shard, "_row": row_key}).withColumn("_slice", hex_long(F.col("_row"), 3))
    before = W.partitionBy("shard").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_slice").agg(F.count("*").alias("_rows"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    number = F.row_number().over(W.partitionBy("shard", "_slice").orderBy("_row", "doc_id"))
    return (
        placed.withColumn("_number", number)
        .join(starts, ["shard", "_slice"])
        .withColumns({"slot": F.col("_start") + F.col("_number") - 1, "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
        .select(*(given(c) for c in docs.columns if c.lower() not in own), *own)
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs, 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
