"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the last bytes cuts every text into chunks where the hash has a fixed pattern, so
equal passages give equal chunks wherever they stand. Chunks that occur more than once in the corpus
are encoded once and their ids are shared by all occurrences. A chunk may begin and end within a
word; the words that a join cuts are encoded again with the known words on either side, and the ids
stand if those of the neighbours come out as they were; otherwise the text is encoded whole.

Only documents with a shared chunk move. A bit table, sized from the number of shared chunks, tells
while documents are scanned which chunks may be shared: it has no false negatives, and a false positive
only sends a document the longer way. All others are encoded where they are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, written
from .pieces import encoder

#: A chunk ends at one byte in 2**CHUNK_BITS, by the hash of the last WINDOW bytes.
CHUNK_BITS, WINDOW = 9, 8
#: Bits of the table for each shared chunk, two of which are set, and the least and most address bits of a table (32 MB; beyond
#: 2**28 / 16 shared chunks more documents go the longer way, which gives the same ids).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 12, 28
_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
_SPACE = b" \t\n\r\x0b\x0c"


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8; never within a character."""
    if not data:
        return []
    b = np.frombuffer(data, np.uint8)
    g = _GEAR[b]
    h = g.copy()
    for j in range(1, WINDOW):
        h[j:] += g[:-j] << np.uint32(j)
    ends = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    ends = ends[ends < len(b)]
    return [*ends[b[ends] & 0xC0 != 0x80].tolist(), len(b)]


def _chunks(data: bytes) -> list[bytes]:
    ends = chunk_ends(data)
    return [data[s:e] for s, e in zip([0, *ends], ends)]


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a table of 2**bits for each 128-bit hash."""
    two = hashes.view("<u8").reshape(-1, 2) >> np.uint64(64 - bits)
    return two[:, 0].astype(np.int64), two[:, 1].astype(np.int64)


def _parts(chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
    """The piece of a word at the start, the whole words, the piece at the end; None without white space."""
    words = chunk.split()
    if len(chunk.split(None, 1)) < 2 and not (chunk[:1] in _SPACE or chunk[-1:] in _SPACE):
        return None
    head = words.pop(0) if words and chunk[0] not in _SPACE else b""
    tail = words.pop() if words and chunk[-1] not in _SPACE else b""
    return head, words, tail


def shared_chunk_table(docs: DataFrame) -> np.ndarray:
    """The bit table of chunks that occur more than once in the texts of docs."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("hash", pa.binary())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"hash": [xxhash.xxh3_128_digest(c) for t in b["text"].to_pylist() for c in _chunks(t.encode())]}, schema=schema)

    shared = written(docs.mapInArrow(hashed, "hash binary").groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "bpe-shared")
    bits = min(max(math.ceil(math.log2(BITS_EACH * max(1, shared.count()))), LEAST_BITS), MOST_BITS)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.concatenate(_positions(np.frombuffer(b"".join(b["hash"].to_pylist()), np.uint8), bits))
            yield pa.RecordBatch.from_pydict({"bit": pa.array(both, pa.int64())})

    words = shared.mapInArrow(placed, "bit long").groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)  # at most as many rows come to the driver
    for b in words.toArrow().to_batches():
        out[b["word"].to_numpy()] = b["bits"].to_numpy()
    return out.view(np.uint64)


def _may_be_shared(table: np.ndarray, hashes: list[bytes]) -> np.ndarray:
    one, two = _positions(np.frombuffer(b"".join(hashes), np.uint8), 5 + len(table).bit_length())
    has = lambda at: (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return (has(one) & has(two)).astype(bool)


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, binary, if asked for), one row per row.

    Ids are those of the tokenizers library for the whole text without special tokens added; special
    tokens written out in a text are encoded as the library does. A null text counts as empty, and the
    empty text has no ids. Null and repeated ids and repeated rows are encoded row by row, very long texts
    whole. An empty table gives no rows; other columns of docs, whatever their names, are not read. Chunks
    are reused by tokenizers that drop white space; others look across it and encode every text where it is read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    small_batches(spark)
    reuses = encoder(path).kind == "words"
    table = spark.sparkContext.broadcast(shared_chunk_table(texts.select("text")) if reuses else np.zeros(1 << (LEAST_BITS - 6), np.uint64))
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())])
    # The texts of documents that wait are compressed one by one; they are most of what moves.
    scanned = pa.schema([("row", pa.int64()), *out, ("text", pa.binary())])
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"

    def digest(ids: bytes, shown: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown).hexdigest(), ids if with_ids else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, row = encoder(path), TaskContext.get().partitionId() << 33
        for b in batches:
            ids, texts_ = b["doc_id"].to_pylist(), b["text"].to_pylist()
            chunks = [[xxhash.xxh3_128_digest(c) for c in _chunks(t.encode())] for t in texts_]
            flat = [h for c in chunks for h in c]
            hit = _may_be_shared(table.value, flat) if flat else np.zeros(0, bool)
            ends = np.cumsum([len(c) for c in chunks])
            waits = [bool(hit[x - len(c) : x].any()) for x, c in zip(ends, chunks)]
            now = e.encode_and_show([t for t, w in zip(texts_, waits) if not w])
            done = iter(now)
            rows = [(row + k, i, None, None, None, None, zstandard.compress(t.encode())) if w else (row + k, i, *digest(*next(done)), None) for k, (i, t, w) in enumerate(zip(ids, texts_, waits))]
            row += len(rows)
            yield pa.RecordBatch.from_pydict(dict(zip(scanned.names, zip(*rows) if rows else [()] * len(scanned))), schema=scanned)

    first = written(texts.mapInArrow(scan, f"row long, {ddl}, text binary"), "bpe-scan")
    waiting = first.filter(F.col("text").isNotNull()).select("row", "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("seq", pa.int32()), ("hash", pa.binary()), ("chunk", pa.binary())])
        for b in batches:
            found = [(r, k, xxhash.xxh3_128_digest(c), c) for r, t in zip(b["row"].to_pylist(), map(zstandard.decompress, b["text"].to_pylist())) for k, c in enumerate(_chunks(t))]
            if found:
                found = [x for x, h in zip(found, _may_be_shared(table.value, [x[2] for x in found])) if h]
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*found) if found else [()] * 4)), schema=schema)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of the whole words of each different chunk."""
        schema, e = pa.schema([("hash", pa.binary()), ("code", pa.binary())]), encoder(path)
        for b in batches:
            parts = [_parts(c) for c in b["chunk"].to_pylist()]
            inner = e.encode([b" ".join(p[1]).decode() if p else "" for p in parts])
            yield pa.RecordBatch.from_pydict({"hash": b["hash"], "code": inner}, schema=schema)

    occurrences = waiting.mapInArrow(cut, "row long, seq int, hash binary, chunk binary")
    codes = occurrences.groupBy("hash").agg(F.first("chunk").alias("chunk")).mapInArrow(once, "hash binary, code binary")
    codes = written(codes, "bpe-chunks")
    by_row = occurrences.select("row", "seq", "hash").join(codes, "hash").groupBy("row").agg(F.collect_list(F.struct("seq", "code")).alias("codes"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            plans, windows = [], []
            for t, codes_ in zip(map(zstandard.decompress, b["text"].to_pylist()), b["codes"].to_pylist()):
                known = {c["seq"]: c["code"] for c in codes_ or []}
                plan, carry, left = [], b"", b""
                # Neighbouring chunks without shared ids go on as one.
                runs: list[tuple[bytes | None, bytes]] = []
                for k, c in enumerate(_chunks(t)):
                    if k in known or not runs or runs[-1][0] is not None:
                        runs.append((known.get(k), c))
                    else:
                        runs[-1] = (None, runs[-1][1] + c)
                for code, c in runs:
                    parts = _parts(c)
                    if parts is None:
                        carry += c
                        continue
                    head, inner, tail = parts
                    if carry + head:
                        plan.append(("join", len(windows)))
                        windows.append((left, carry + head, inner[0] if inner else b""))
                        left = carry + head
                    if inner:
                        plan.append(("chunk", code, inner))
                        left = inner[-1]
                    carry = tail
                if carry:
                    plan.append(("join", len(windows)))
                    windows.append((left, carry, b""))
                plans.append((t, plan))
            e.turn()
            e.learn({x for w in windows for x in w if x}.union(*(p[2] for _, plan in plans for p in plan if p[0] == "chunk" and p[1] is None)))
            known_ids = e.ids
            different = list({b" ".join(filter(None, w)) for w in windows})
            together = dict(zip(different, e.through_library(different)))
            agreed = [b"".join([known_ids[x] for x in w if x]) == together[b" ".join(filter(None, w))] for w in windows]
            rows = []
            for i, (t, plan) in zip(b["doc_id"].to_pylist(), plans):
                ids, whole = [], False
                for p in plan:
                    if p[0] == "join":
                        whole |= not agreed[p[1]]
                        ids.append(known_ids[windows[p[1]][1]])
                    else:
                        ids.append(b"".join([known_ids[x] for x in p[2]]) if p[1] is None else p[1])
                all_ids = e.encode_batch([t])[0][0] if whole else b"".join(ids)
                rows.append((i, *digest(all_ids, e.decode(all_ids))))
            yield pa.RecordBatch.from_pydict(dict(zip(out.names, zip(*rows) if rows else [()] * len(out))), schema=out)

    rest = waiting.join(by_row, "row", "left").select("doc_id", "text", "codes").mapInArrow(joined, ddl)
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    return first.filter(F.col("text").isNull()).select(columns).unionByName(rest.select(columns))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
