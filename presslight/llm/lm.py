"""Language-model scoring with an Elias-Fano bigram trie.

The model is a bigram model over the training documents, smoothed by a Dirichlet prior on the
add-one unigram model: p(w|v) = (c(v w) + MU p1(w)) / (c(v) + MU), p1(w) = (c(w) + 1) / (N + V + 1);
a context not in training leaves p1. Words become numbers in order of falling frequency class; what a
word's count has above the least of its class goes with the bigrams, so that all counts are exact. log10
probabilities of the bigrams are kept as 16-bit codes.

The corpus is read in batches of documents. Between batches and shards go packed arrays, each
pre-aggregated: first a batch's distinct words (their counts and numbers come back), then its distinct
bigrams with the documents they are in. A shard of bigrams, dealt by context and for frequent contexts
by successor too, builds its part of the trie from the training documents and looks up every bigram
of its batches in it. A document's score is its sum of back-off terms, known in its batch, and of what
the trie has above back-off, which the shards send. So the model is never in one place, and no
word or pair, however frequent, weighs more than a row per document in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, written
from .eliasfano import Trie

MU = 1000.0
FOLDS, HELD_OUT = 7, 2
#: Codes are this fine, from log10 probability 0 down.
STEPS = 4096
#: Tokens for each shard, about, and the least shards.
SHARD_TOKENS, SHARDS_LEAST = 1 << 21, 64
#: Documents of a batch at most; Arrow batches also end at 16 MB.
BATCH_DOCS = 2048
#: A context with more tokens than this is dealt over more shards by its successors.
SPLIT_TOKENS = 1 << 18
KEPT_WORDS = 200_000
#: Numbers of the two contexts and successors that are no training words.
START, UNKNOWN = 0xFFFFFFFE, 0xFFFFFFFF
_END = xxhash.xxh3_64_intdigest(b"")


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; each as bytes of equal rank together, which compress well."""
    parts, head = [], [len(arrays)]
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind = np.dtype(a.dtype)
        if kind.kind == "u" and kind.itemsize > 1:
            most = int(a.max()) if len(a) else 0
            kind = np.dtype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")
            a = a.astype(kind)
        head += [ord(kind.char), len(a)]
        parts.append(a.view(np.uint8).reshape(len(a), kind.itemsize).T.tobytes())
    return zstandard.compress(np.array(head, "<i8").tobytes() + b"".join(parts), 1)


def _open(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for k in range(n):
        kind, size = np.dtype(chr(head[2 * k])), int(head[2 * k + 1])
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


#: Frequency classes: counts up to 64 exactly, then 16 to each doubling. CLASS_LEAST has the least count of each.
CLASS_LEAST = np.unique(np.concatenate([np.arange(1, 65), np.ceil(64 * 2 ** (np.arange(1, 16 * 50) / 16)).astype(np.int64)]))


def _class_of(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(CLASS_LEAST, count, side="right") - 1


def tokenised(docs: DataFrame) -> DataFrame:
    """A row per batch: batch, n_train (its training tokens), and packed: documents, tokens as places in its distinct words, those words' keys and training counts."""
    schema = pa.schema([("batch", pa.int64()), ("n_tokens", pa.int64()), ("n_train", pa.int64()), ("train_docs", pa.int64()), ("ids", pa.list_(pa.int64())), ("data", pa.binary()), ("words", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for k, b in enumerate(batches):
            keys, sizes = [], []
            for t in b["text"].to_pylist():
                words = t.encode("utf-8", "surrogatepass").lower().split()
                if len(known) > KEPT_WORDS:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = xxhash.xxh3_64_intdigest(w)
                keys.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                keys.append(np.array([_END], np.uint64))
                sizes.append(len(words) + 1)
            ids = b["doc_id"].to_pylist()
            held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in ids], bool)
            sizes = np.array(sizes, np.uint32)
            distinct, tokens, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # frequent words get small places
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            tokens = place[tokens]
            train = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(order)).astype(np.uint32)
            row = [(TaskContext.get().partitionId() << 24) + k, len(tokens), int(train.sum()), int((~held).sum()), ids, _squeeze(held.astype(np.uint8), sizes, tokens), _squeeze(distinct[order], train)]
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(schema.names, row)}, schema=schema)

    return docs.mapInArrow(pack, "batch long, n_tokens long, n_train long, train_docs long, ids array<long>, data binary, words binary")


def vocabulary(batches: DataFrame, shards: int) -> DataFrame:
    """What each shard of words answers each batch: count, class and rank of the batch's words of that shard; and, with batch -1, how many words of each class the shard has."""

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for batch, words in zip(b["batch"].to_pylist(), b["words"].to_pylist()):
                keys, train = _open(words)
                shard = (_stir(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                ends = np.cumsum(np.bincount(shard, minlength=shards))
                rows = [_squeeze(keys[part], train[part]) for part in np.split(order, ends[:-1])]
                yield pa.RecordBatch.from_pydict({"shard": pa.array(range(shards), pa.int32()), "batch": pa.array([batch] * shards, pa.int64()), "data": rows})

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        opened = [_open(d) for d in pdf["data"]]
        keys, back = np.unique(np.concatenate([o[0] for o in opened]).astype(np.uint64), return_inverse=True)
        total = np.bincount(back, np.concatenate([o[1] for o in opened]).astype(np.float64), len(keys)).astype(np.int64)
        kind = _class_of(total)
        sizes = np.bincount(kind[total > 0], minlength=len(CLASS_LEAST))
        order = np.lexsort((keys, kind))
        rank = np.empty(len(keys), np.int64)
        firsts = np.searchsorted(kind[order], kind[order])
        rank[order] = np.arange(len(keys)) - firsts
        answers, at = [_squeeze(sizes.astype(np.uint64))], 0
        for o in opened:
            mine = back[at : at + len(o[0])]
            answers.append(_squeeze(total[mine].astype(np.uint64), rank[mine].astype(np.uint64)))
            at += len(mine)
        return pd.DataFrame({"shard": key[0], "batch": [-1, *pdf["batch"]], "data": answers})

    asked = batches.select("batch", "words").mapInArrow(ask, "shard int, batch long, data binary")
    return asked.groupBy("shard").applyInPandas(count, "shard int, batch long, data binary")


def score_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Words are runs of anything but ASCII white space, A-Z lower-cased, and an end follows them; a null
    text counts as empty. Documents whose crc32(doc_id as text) mod 7 is 2 are held out of training;
    a null id counts as the empty text. base_score is the add-one unigram log10 probability, score the
    bigram model's. Repeated rows count in training each. An empty table gives no rows; without training
    documents N and V are 0 and both scores are 0.
    """
    spark = docs.sparkSession
    small_batches(spark, BATCH_DOCS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    batches = written(tokenised(texts), "lm-batches")
    n_tokens, n_train, train_docs = (int(x or 0) for x in batches.agg(F.sum("n_tokens"), F.sum("n_train"), F.sum("train_docs")).first())
    shards = max(SHARDS_LEAST, n_tokens // SHARD_TOKENS)
    answers = written(vocabulary(batches, shards), "lm-vocabulary")
    # Words by class and shard: shards times some hundred classes, whatever the corpus.
    sizes = np.zeros((shards, len(CLASS_LEAST)), np.int64)
    for r in answers.filter("batch = -1").select("shard", "data").collect():
        sizes[r["shard"]] = _open(r["data"])[0]
    n_words = int(sizes.sum())
    by_class = sizes.T[::-1]  # frequent classes first
    offsets = (np.cumsum(by_class) - by_class.ravel()).reshape(by_class.shape)[::-1].T
    class_ends = np.cumsum(by_class.sum(axis=1))
    known = spark.sparkContext.broadcast((offsets, class_ends))
    everything = n_train + n_words + 1

    def least_of(numbers: np.ndarray) -> np.ndarray:
        """The least count of a word's class; START has its count."""
        back = np.searchsorted(known.value[1], numbers, side="right")
        return np.where(numbers == START, train_docs, CLASS_LEAST[len(CLASS_LEAST) - 1 - np.minimum(back, len(CLASS_LEAST) - 1)])

    def above(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What the counts of the distinct numbers have above their classes' least, by ascending number."""
        distinct, at = np.unique(numbers, return_index=True)
        return (counts[at] - least_of(distinct)).astype(np.uint64)

    def counts_of(distinct: np.ndarray, numbers: list[np.ndarray], more: list[np.ndarray]) -> np.ndarray:
        """The exact counts of distinct numbers, from what each batch sent of its own."""
        counts = least_of(distinct)
        for x, m in zip(numbers, more):
            at = np.searchsorted(distinct, np.unique(x))
            counts[at] = least_of(distinct[at]) + m.astype(np.int64)
        return counts.astype(np.float64)

    def ask(key: tuple, mine: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        """A batch: its documents' rows, and its bigrams for each shard."""
        row, found = mine.iloc[0], {s: _open(d) for s, d in zip(words["shard"], words["data"])}
        held, doc_sizes, tokens = _open(row["data"])
        keys, _ = _open(row["words"])
        shard = (_stir(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        count, number = np.zeros(len(keys), np.int64), np.full(len(keys), UNKNOWN, np.uint64)
        for s, part in enumerate(np.split(np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=shards))[:-1])):
            if len(part):
                total, rank = (x.astype(np.int64) for x in found[s])
                count[part] = total
                number[part] = np.where(total > 0, known.value[0][s, np.maximum(_class_of(total), 0)] + rank, UNKNOWN).astype(np.uint64)
        doc = np.repeat(np.arange(len(doc_sizes), dtype=np.uint32), doc_sizes)
        first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
        successor, p1 = number[tokens], np.log10((count[tokens] + 1) / everything)
        context = np.where(first, np.uint64(START), np.roll(successor, 1))
        c1 = np.where(first, train_docs, np.roll(count[tokens], 1))
        back_off = np.where(c1 > 0, np.log10(MU / (c1 + MU)) + p1, p1)
        sums = [np.bincount(doc, x, len(doc_sizes)) for x in (count[tokens] > 0, p1, back_off)]
        docs_row = {"batch": row["batch"], "shard": int(row["batch"] % shards), "ids": row["ids"], "data": _squeeze(held, doc_sizes, sums[0].astype(np.uint32), sums[1], sums[2])}

        ok = (context != UNKNOWN) & (successor != UNKNOWN)
        context, successor, doc, c1, c2 = context[ok], successor[ok], doc[ok], c1[ok], count[tokens][ok]
        order = np.lexsort((doc, successor, context))
        context, successor, doc, c1, c2 = context[order], successor[order], doc[order], c1[order], c2[order]
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (successor[1:] != successor[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(new))).astype(np.uint32)
        context, successor, doc, c1, c2 = context[at], successor[at], doc[at], c1[at], c2[at]
        spread = np.maximum(1, c1 // SPLIT_TOKENS).astype(np.uint64)
        to = (_stir(context + _stir(successor + np.uint64(1)) % spread * np.uint64(1 << 40)) % np.uint64(shards)).astype(np.int64)
        rows = [docs_row]
        for s, part in enumerate(np.split(np.argsort(to, kind="stable"), np.cumsum(np.bincount(to, minlength=shards))[:-1])):
            if len(part):
                rows.append({"batch": row["batch"], "shard": s, "ids": None, "data": _squeeze(context[part], successor[part], doc[part], times[part], held, above(context[part], c1[part]), above(successor[part], c2[part]))})
        return pd.DataFrame(rows)

    def look_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A shard: its trie, and what each document of each batch has above back-off."""
        through, asked = pdf[pdf["ids"].notna()], pdf[pdf["ids"].isna()]
        if not len(asked):
            return through.drop(columns="shard")
        opened = [_open(d) for d in asked["data"]]
        pairs = np.concatenate([o[0].astype(np.uint64) << np.uint64(32) | o[1].astype(np.uint64) for o in opened])
        train = np.concatenate([np.where(o[4][o[2]] == 0, o[3], 0) for o in opened]).astype(np.float64)
        pairs, back = np.unique(pairs, return_inverse=True)
        seen = np.bincount(back, train, len(pairs))
        context, successor = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        (contexts, c), (successors, w) = np.unique(context, return_inverse=True), np.unique(successor, return_inverse=True)
        before = counts_of(contexts, [o[0] for o in opened], [o[5] for o in opened])[c]
        p1 = (counts_of(successors, [o[1] for o in opened], [o[6] for o in opened])[w] + 1) / everything
        in_trie = seen > 0
        p = (seen[in_trie] + MU * p1[in_trie]) / (before[in_trie] + MU)
        trie = Trie.build(context[in_trie], successor[in_trie], np.rint(-np.log10(p) * STEPS).astype(np.uint16))
        place = trie.find(context, successor)
        gain = np.where(place >= 0, -trie.codes[np.maximum(place, 0)].astype(np.float64) / STEPS - np.log10(MU * p1 / (before + MU)), 0.0) if trie.codes.size else np.zeros(len(pairs))
        rows, at = [], 0
        for batch, o in zip(asked["batch"], opened):
            mine = gain[back[at : at + len(o[0])]] * o[3]
            at += len(o[0])
            rows.append({"batch": batch, "ids": None, "data": _squeeze(np.bincount(o[2], mine, len(o[4])).astype(np.float32))})
        return pd.concat([through.drop(columns="shard"), pd.DataFrame(rows)])

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf[pdf["ids"].notna()].iloc[0]
        held, size, n_known, base, score = _open(row["data"])
        for d in sorted(pdf["data"][pdf["ids"].isna()]):  # in one order, for equal sums on every run
            score = score + _open(d)[0]
        ids = pd.array([None if pd.isna(i) else int(i) for i in row["ids"]], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "held_out": held.astype(bool), "n_tokens": size.astype(np.int64), "n_known": n_known.astype(np.int64), "train_tokens": n_train, "base_score": base, "score": score})

    requests = batches.select("batch", "ids", "data", "words").groupBy("batch").cogroup(answers.filter("batch >= 0").groupBy("batch")).applyInPandas(ask, "batch long, shard int, ids array<long>, data binary")
    found = requests.groupBy("shard").applyInPandas(look_up, "batch long, ids array<long>, data binary")
    return found.groupBy("batch").applyInPandas(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
