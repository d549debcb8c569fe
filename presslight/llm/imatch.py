"""Document fingerprints by I-Match over several randomised lexicon subsets.

The lexicon are the terms within a band of inverse document frequency. Document frequencies are
counted over all documents for each term (by 64-bit hash), added up in each task and then by ranges of
hashes; the hashes of the band's terms, 8 bytes each, go to the tasks. Both edges of the band are shares of
the documents, so a corpus with D distinct terms a document has at most D / LEAST_SHARE terms in it,
however large it is. A document keeps its distinct terms in the band (all its terms,
if none is), sorts them, and hashes those of each of 64 random subsets of the lexicon. Subsets come in
rates from 1/4 to 1/4096: the dense ones tell near-identical texts apart, the sparse ones still agree
after larger edits of long texts. Likeness is the share of equal hashes among the subsets that either
document has terms in.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, written
from .lm import _open, _squeeze

#: A term is in the band if at least this share of the documents have it, and two at least, and no more than this share (and always up to ALWAYS).
LEAST_SHARE, LEAST_DF, SHARE, ALWAYS = 1e-5, 2, 0.05, 10
#: Subsets of each rate: (a term is in one of `rate` slots, the first `count` slots are the subsets).
RATES = ((4, 4), (16, 8), (64, 12), (256, 14), (1024, 14), (4096, 12))
SUBSETS = sum(n for _, n in RATES)
KEPT_WORDS = 150_000
#: Distinct terms that a task counts before it sends them on; characters for each range of hashes, about, and the least ranges.
COUNTED_WORDS, SHARD_CHARS, SHARDS_LEAST = 1_000_000, 1 << 24, 64


def terms(text: str) -> set[bytes]:
    """Distinct words, A-Z lower-cased."""
    return set(text.encode("utf-8", "surrogatepass").lower().split())


def band_terms(docs: DataFrame) -> np.ndarray:
    """The hashes of the terms whose document frequency is in the band, ascending."""
    small_batches(docs.sparkSession)
    n, size = (int(x or 0) for x in docs.agg(F.count("*"), F.sum(F.length("text"))).first())
    least, most, shards = max(LEAST_DF, math.ceil(LEAST_SHARE * n)), max(ALWAYS, math.floor(SHARE * n)), max(SHARDS_LEAST, size // SHARD_CHARS)
    schema = pa.schema([("shard", pa.int32()), ("data", pa.binary())])

    def packed(df: Counter) -> pa.RecordBatch:
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, df), np.uint64, len(df))
        counts = np.fromiter(df.values(), np.uint64, len(df))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)  # ranges of hashes
        firsts = np.flatnonzero(np.diff(shard, prepend=-1))
        rows = [_squeeze(np.diff(keys[a:b], prepend=np.uint64(0)), counts[a:b]) for a, b in zip(firsts, np.append(firsts[1:], len(keys)))]
        return pa.RecordBatch.from_pydict({"shard": pa.array(shard[firsts], pa.int32()), "data": pa.array(rows, pa.binary())}, schema=schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for b in batches:
            for t in b["text"].to_pylist():
                df.update(terms(t))
                if len(df) > COUNTED_WORDS:
                    yield packed(df)
                    df.clear()
        yield packed(df)

    def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        opened = [_open(d) for d in pdf["data"]]
        keys, back = np.unique(np.concatenate([np.cumsum(o[0], dtype=np.uint64) for o in opened]), return_inverse=True)
        df = np.bincount(back, np.concatenate([o[1] for o in opened]).astype(np.float64), len(keys))
        kept = keys[(df >= least) & (df <= most)]
        return pd.DataFrame({"shard": [key[0]], "data": [_squeeze(np.diff(kept, prepend=np.uint64(0)))]})

    found = docs.mapInArrow(counted, "shard int, data binary").groupBy("shard").applyInPandas(summed, "shard int, data binary")
    parts = [np.cumsum(_open(r["data"])[0], dtype=np.uint64) for r in sorted(found.collect(), key=lambda r: r["shard"])]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


class Fingerprinter:
    def __init__(self, lexicon: np.ndarray):
        self.lexicon, self.known = lexicon, {}

    def _in_band(self, words: list[bytes]) -> list[bool]:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if not len(self.lexicon):
            return [False] * len(words)
        at = np.searchsorted(self.lexicon, h)
        return (self.lexicon[np.minimum(at, len(self.lexicon) - 1)] == h).tolist()

    @staticmethod
    def _subsets(word: bytes) -> tuple[int, ...]:
        slots, first, draw = [], 0, xxhash.xxh3_128_intdigest(word, 5)
        for rate, count in RATES:
            slot = draw % rate
            draw //= rate
            if slot < count:
                slots.append(first + slot)
            first += count
        return tuple(slots)

    def __call__(self, words: set[bytes]) -> list[int]:
        """A hash of 32 bits for each subset, 0 for a subset without terms of the document."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = list(words.difference(self.known))
        for w, kept in zip(new, self._in_band(new)):
            self.known[w] = kept, self._subsets(w)
        kept = [w for w in words if self.known[w][0]] or words
        subsets: list[list[bytes]] = [[] for _ in range(SUBSETS)]
        for w in sorted(kept):
            for k in self.known[w][1]:
                subsets[k].append(w)
        return [(xxhash.xxh32_intdigest(b"\n".join(s)) or 1) if s else 0 for s in subsets]


def shown(marks: list[int]) -> str:
    return "".join("%08x" % m for m in marks)


def likeness(a: list[int], b: list[int]) -> float:
    """Share of equal hashes among the subsets that either has; 1 for two documents without terms."""
    either = sum(1 for x, y in zip(a, b) if x or y)
    return sum(1 for x, y in zip(a, b) if x and x == y) / either if either else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points, rounded down, replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row.

    The next document is the next by ascending doc_id (null ids last, equal ids by a hash of the text), after
    the last the first. A null text counts as empty; an empty text has the fingerprint of no terms, all zeros.
    Equal texts have equal fingerprints; repeated rows each have a row, very long texts are read whole. An
    empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    lexicon = spark.sparkContext.broadcast(band_terms(texts.select("text")))
    results = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    out = pa.schema(results)
    ends = pa.schema([("kind", pa.string()), ("part", pa.int32()), *results, ("text", pa.string())])
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row(marks: Fingerprinter, doc_id, text: str, mine: list[int], following: str, theirs: list[int]) -> tuple:
        other = edited(text, following)
        new = marks(terms(other))
        return doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), shown(mine), shown(new), likeness(mine, new), likeness(mine, theirs)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield b.set_column(2, "text", pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in b["text"].to_pylist()], pa.binary()))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sorted part: finished rows, and the texts at its two ends, which need another part."""
        marks, part, last = Fingerprinter(lexicon.value), TaskContext.get().partitionId(), None
        for b in batches:
            rows = []
            for i, z in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                t = zstandard.decompress(z).decode("utf-8", "surrogatepass")
                mine = marks(terms(t))
                if last is None:
                    rows.append(("first", part, i, *[None] * 6, t))
                else:
                    rows.append(("done", part, *row(marks, *last, t, mine), None))
                last = (i, t, mine)
            yield pa.RecordBatch.from_pydict(dict(zip(ends.names, zip(*rows) if rows else [()] * len(ends))), schema=ends)
        if last is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(ends.names, [[x] for x in ("last", part, last[0], *[None] * 6, last[1])])), schema=ends)

    def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Fingerprinter(lexicon.value)
        for b in batches:
            rows = [row(marks, i, t, marks(terms(t)), f, marks(terms(f))) for i, t, f in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "following")))]
            yield pa.RecordBatch.from_pydict(dict(zip(out.names, zip(*rows) if rows else [()] * len(out))), schema=out)

    # Every text moves once, to stand beside its neighbour, compressed.
    order = F.col("doc_id").asc_nulls_last()
    moved = texts.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(packed, "doc_id long, tie long, text binary")
    parts = moved.repartitionByRange(order).sortWithinPartitions(order, "tie", "text").select("doc_id", "text").mapInArrow(neighbours, f"kind string, part int, {ddl}, text string")
    parts = written(parts, "imatch")
    # The part after each; a number for each part of the range partitioning goes through the window.
    heads = parts.filter("kind = 'first'").select("part", "text")
    line = W.partitionBy(F.lit(0)).orderBy("part")
    after = heads.select("part").select("part", F.coalesce(F.lead("part").over(line), F.first("part").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    heads = after.join(heads.toDF("after", "following"), "after").select("part", "following")
    closed = parts.filter("kind = 'last'").select("part", "doc_id", "text").join(heads, "part").select("doc_id", "text", "following").mapInArrow(closing, ddl)
    return parts.filter("kind = 'done'").select(out.names).unionByName(closed)


def op5_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
