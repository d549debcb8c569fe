"""Quality classifier: supervised subword embeddings.

Words and their character n-grams are hashed into buckets, each with a learned vector; a document is
the average of its vectors, and a softmax over two outputs gives the score of label 1. The vectors
are trained by numpy stochastic gradient descent on a bounded sample of labelled rows.

Average and output are linear, so for scoring the model shrinks to one number per bucket (2**BITS of
them, whatever the corpus); that array goes to the tasks, and a word's sum is kept while it recurs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, given, small_batches, text_or_empty

BITS, GRAMS = 16, (3, 4)
#: The most labelled rows that training takes, chosen by a hash of the id.
SAMPLE = 2000
DIM, BATCH, RATE, SEED = 12, 2, 1.0, 11
#: Examples that training goes through, in whole rounds over the sample, within these rounds.
EXAMPLES, ROUNDS = 20_000, (4, 60)
#: Stands, as a word of its own, beside a word that repeats the one before it.
SAME = "\n"
#: What scoring adds to the columns of documents.
ADDED = ("held_out", "score", "predicted")
#: Words whose sums a worker keeps.
KEPT_WORDS = 200_000


_MASK = (1 << BITS) - 1
#: Each size of n-gram and the checksum of its digit, with which the checksums of its n-grams begin.
_STARTS = [(n, zlib.crc32(b"%d" % n)) for n in GRAMS]


def features(word: str) -> list[int]:
    """Buckets of a word and of the character n-grams of <word>."""
    marked, crc = f"<{word}>", zlib.crc32
    data = marked.encode()
    found = [crc(data) & _MASK]
    for n, start in _STARTS:
        places = range(len(marked) - n + 1) if len(marked) > n else ()
        if len(data) == len(marked):
            found += [crc(data[i : i + n], start) & _MASK for i in places]
        else:
            found += [crc(marked[i : i + n].encode(), start) & _MASK for i in places]
    return found


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts."""
    counts: dict[str, int] = {}
    last = None
    for w in text.split():
        counts[w] = counts.get(w, 0) + 1
        if w == last:
            counts[SAME] = counts.get(SAME, 0) + 1
        last = w
    sums = np.zeros(1 << BITS)
    for w, n in counts.items():
        for b in features(w):
            sums[b] += n
    at = np.flatnonzero(sums)
    return at.astype(np.uint16), sums[at].astype(np.float32)


@dataclass(frozen=True)
class Model:
    #: What a bucket adds to the difference of the two outputs; the difference with no buckets.
    weights: np.ndarray
    bias: float

    def score(self, total: float, n: int) -> float:
        """Softmax of label 1, from the sum of weights over n buckets."""
        z = self.bias + (total / n if n else 0.0)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Stochastic gradient descent on the softmax loss, in a fixed order; without rows, the score is 0.5 everywhere."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    output, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    rounds = min(max(EXAMPLES // max(1, len(bags)), ROUNDS[0]), ROUNDS[1])
    steps, step = max(1, rounds * -(-len(bags) // BATCH)), 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for first in range(0, len(bags), BATCH):
            some = [bags[i] for i in order[first : first + BATCH]]
            y = np.eye(2, dtype=np.float32)[labels[order[first : first + BATCH]]]
            parts = [n / max(1.0, n.sum()) for _, n in some]
            hidden = np.stack([p @ vectors[at] for (at, _), p in zip(some, parts)])
            z = hidden @ output + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            grad = (p / p.sum(axis=1, keepdims=True) - y) / len(some)
            rate = RATE * (1 - step / steps)
            back = grad @ output.T
            output -= rate * hidden.T @ grad
            bias -= rate * grad.sum(axis=0)
            for (at, _), share, g in zip(some, parts, back):
                vectors[at] -= rate * np.outer(share, g)
            step += 1
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows outside fold 0, of at most `sample` of them.

    Rows of labels without id or quality are not used; of several for one id, the mean decides
    (0.5 or more: 1). Of documents with one id, each is an example, up to `sample` rows in all, by a hash of id
    and text. Null texts count as empty ones; an empty table gives a model that scores 0.5.
    """
    marked = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bag(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b["doc_id"], "label": b["_label"], "at": [x.tobytes() for x, _ in found], "n": [x.tobytes() for _, x in found]}, schema=pa.schema([("id", pa.int64()), ("label", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

    small_batches(docs.sparkSession)
    chosen = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(marked), "doc_id")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(sample)
    rows = sorted(chosen.mapInArrow(bags, "id long, label int, at binary, n binary").collect(), key=lambda r: (r["id"], r["at"], r["n"]))
    return train([(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["n"], np.float32)) for r in rows], np.array([r["label"] for r in rows], dtype=int))


class _Sums(dict):
    """Of each word the sum of its buckets' weights and, as the imaginary part, their number; a text's are the sums of its words'."""

    def __init__(self, weights: list[float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> complex:
        at = features(word)
        found = self[word] = complex(sum(map(self.weights.__getitem__, at)), len(at))
        return found


def score_documents(docs: DataFrame, model: Model, least: float = 0.3, folds: int = 5) -> DataFrame:
    """docs with held_out, score (of label 1; an empty or null text has the score of no features) and predicted.

    Every row is scored by itself, from its whole text however long: repeated rows alike, and rows with a null
    id too. An empty table gives no rows. Columns of docs with these three names are replaced; all others pass
    through, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    inner = docs.drop(*ADDED)
    schema = inner.withColumn("score", F.lit(0.0)).schema
    index = inner.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, _Sums(shared.value.weights.tolist())
        same = known[SAME]
        for b in batches:
            scores = []
            for t in b.column(index).to_pylist():
                words = (t or "").split()
                both = sum(map(known.__getitem__, words), 0j) + same * sum(map(eq, words, islice(words, 1, None)))
                scores.append(m.score(both.real, round(both.imag)))
            if len(known) >= KEPT_WORDS:
                known.clear()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=schema.names)

    return inner.mapInArrow(scored, schema).withColumns(
        {"held_out": fold_of(F.col("doc_id"), folds) == 0, "predicted": (F.col("score") >= least).cast("int")}
    )


def good_documents(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs that score `least` or more, with all columns as they are."""
    clashing = {c: f"in:{c}" for c in docs.columns if c.lower() in ADDED}
    good = score_documents(docs.withColumnsRenamed(clashing), model, least).filter("predicted = 1")
    return good.select(*(given(c) if c in clashing else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_documents(docs, fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")
