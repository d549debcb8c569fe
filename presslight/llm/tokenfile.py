"""Token-id files of directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level k the
k-th chunk of those ids that go on; a bitmap per level tells which do, and a directory holds the number
of set bits before each 512. The place of an id's next chunk is the rank of its bit, so any id is
read with a few look-ups, without decoding a block.

A file is a run of documents in ascending doc_id order, as segments: rows of a Parquet table that
Spark writes and commits. A segment's buffer has a header, the index of its documents and the levels,
all addressed from the start, so it can be mapped as it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, written
from .pieces import encoder

MAGIC = 0x43414431
#: Ids after which a segment is closed, at the end of a document.
SEGMENT_IDS = 1 << 18
RANK_BITS = 512
#: Documents encoded at once, if their texts take no more than a batch's bytes: the more, the fewer times a worker looks up a piece that recurs.
BATCH_ROWS = 2048


def pack(ids: np.ndarray, doc_ids: list, counts: list[int]) -> bytes:
    """A segment of the ids of some documents: counts of each, ids one after another."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        goes_on = rest >= 256
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
        blocks = np.bitwise_count(bits.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        levels.append((len(rest), (rest & 255).astype(np.uint8), bits, ranks))
        if not goes_on.any():
            break
        rest = rest[goes_on] >> 8
    index = [np.array([0 if i is None else i for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], np.uint8), np.concatenate([[0], np.cumsum(counts)]).astype("<u4")]
    arrays = [*index, *(a for _, *three in levels for a in three)]
    places, at = [], 8 * (4 + len(levels) + len(arrays))
    for a in arrays:
        places.append(at)
        at += a.nbytes + -a.nbytes % 8
    head = np.array([MAGIC, len(doc_ids), len(ids), len(levels), *(n for n, *_ in levels), *places], "<u8")
    return head.tobytes() + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)


class Segment:
    """A packed segment, read in place."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, "<u8", 4)
        if int(head[0]) != MAGIC:
            raise ValueError("not a segment of token ids")
        self.n_docs, self.n_ids, n = (int(x) for x in head[1:])
        sizes = [int(x) for x in np.frombuffer(buffer, "<u8", n, 32)]
        places = [int(x) for x in np.frombuffer(buffer, "<u8", 3 + 3 * n, 32 + 8 * n)]
        view = lambda kind, count, at: np.frombuffer(buffer, kind, count, at)
        self.doc_ids, self.null_ids, self.starts = view("<i8", self.n_docs, places[0]), view(np.uint8, self.n_docs, places[1]), view("<u4", self.n_docs + 1, places[2])
        self.levels = []
        for k, size in enumerate(sizes):
            a, b, c = places[3 + 3 * k : 6 + 3 * k]
            words = -(-size // RANK_BITS) * (RANK_BITS // 64)
            self.levels.append((view(np.uint8, size, a), view("<u8", words, b), view("<u4", words // (RANK_BITS // 64) + 1, c)))

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, by rank from level to level."""
        places = np.asarray(places, np.int64)
        out, live, here = np.zeros(len(places), np.uint32), np.arange(len(places)), places
        for k, (codes, bits, ranks) in enumerate(self.levels):
            out[live] |= codes[here].astype(np.uint32) << np.uint32(8 * k)
            on = (bits[here >> 6] >> (here & 63).astype(np.uint64)) & np.uint64(1) == 1
            live, here = live[on], here[on]
            if not len(live):
                break
            before = ranks[here // RANK_BITS].astype(np.int64)
            first = here // RANK_BITS * (RANK_BITS // 64)
            for j in range(RANK_BITS // 64):
                word = first + j
                inside = word < here >> 6
                before += np.where(inside, np.bitwise_count(bits[np.where(inside, word, 0)]), 0)
            before += np.bitwise_count(bits[here >> 6] & ((np.uint64(1) << (here & 63).astype(np.uint64)) - np.uint64(1)))
            here = before
        return out

    def ids(self) -> np.ndarray:
        """All ids in order: each level's codes go where the level above goes on."""
        out, live = np.zeros(self.n_ids, np.uint32), None
        for k, (codes, bits, _) in enumerate(self.levels):
            part = codes.astype(np.uint32) << np.uint32(8 * k)
            out = part if live is None else out
            if live is not None:
                out[live] |= part
            on = np.flatnonzero(np.unpackbits(bits.view(np.uint8), count=len(codes), bitorder="little"))
            live = on if live is None else live[on]
        return out


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """docs(doc_id, text) as a written table of segments: file, segment, before, n_ids, n_docs, payload.

    Each document's ids (a null text: none) and end_id after them; documents in ascending doc_id
    order, null ids last, equal ids by text. A file is what one task wrote; before counts the file's ids
    in earlier segments. An empty table gives no segments.
    """
    small_batches(docs.sparkSession, rows=BATCH_ROWS)
    order = F.col("doc_id").asc_nulls_last()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = pa.schema([("file", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())])

    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, file, end = encoder(path), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        segment, before, size, doc_ids, held = 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(held), "<u4"), doc_ids, [len(h) // 4 for h in held])
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, ([file], [segment], [before], [size], [len(held)], [payload]))), schema=schema)

        for b in batches:
            for i, ids in zip(b["doc_id"].to_pylist(), e.encode(b["text"].to_pylist())):
                doc_ids.append(i)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SEGMENT_IDS:
                    yield close()
                    segment, before, size, doc_ids, held = segment + 1, before + size, 0, [], []
        if held:
            yield close()

    ordered = texts.repartitionByRange(order).sortWithinPartitions(order, "text")
    return written(ordered.mapInArrow(pack_part, "file int, segment int, before long, n_ids long, n_docs long, payload binary"), "token-files")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the files."""
    sizes = files.groupBy("file").agg(F.sum("n_ids").alias("_ids"))
    earlier = W.partitionBy(F.lit(0)).orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("file", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("base"))  # a row per writing task
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    small_batches(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, payload in zip(b["first"].to_pylist(), b["payload"]):
                s = Segment(payload.as_buffer())
                ids, at = s.ids(), s.starts.astype(np.int64)
                ends = at[1:][np.diff(at) > 0] - 1
                if not np.array_equal(s.at(ends), ids[ends]):  # each document's last id, addressed directly
                    raise ValueError("a segment's levels and directories disagree")
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64(), mask=s.null_ids.astype(bool)), pa.array(first + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=schema)

    placed = files.join(F.broadcast(bases), "file").select((F.col("base") + F.col("before")).alias("first"), "payload")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))
