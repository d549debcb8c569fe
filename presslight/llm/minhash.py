"""MinHash near-dedup with b-bit signatures.

A document's set is its distinct word shingles. Documents with equal sets form a class and go on as
one, so copies never meet in pairs. Of each class 128 minima are taken: bands of four give the
candidate buckets (a pair of similarity 0.8 misses all 32 with probability 5e-8), and the low four
bits of each minimum, packed, give the estimate: equal codes, corrected for the 1 in 16 that collide.
Candidates whose estimate stays far below the threshold (five standard deviations) go; the others
are confirmed on their full sets.

Buckets are not expanded into pairs. First each member is compared with its bucket's smallest member
(a star), and confirmed links are joined into components. Pairs that a star leaves open lie in buckets
that still hold several components. Members of such a bucket meet in packs of bounded size: signatures
tell who has a likely partner in another component, each pair counting in the first band that it shares
only, and these meet once more with their full sets. Of the links that a task confirms it gives a
spanning forest of the components, so no step makes rows for all pairs of a bucket. Then every
candidate pair has been confirmed, rejected, or lies within a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, written

BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
CODES = 64 // BITS  # codes in a long
#: Estimates this far below the threshold are not confirmed; the estimate's deviation is about 0.037.
MARGIN = 0.18
#: Members of a bucket in one pack, and bytes of full sets in one, about.
BLOCK, BLOCK_BYTES = 2048, 1 << 23
#: Strays that are compared with a pack at once.
SLICE = 256
#: Hash buckets of ids that may be broadcast to thin out a scan.
ID_BUCKETS = 1 << 18
KEPT_WORDS = 200_000

_RNG = np.random.default_rng(2024)
_A = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Distinct shingles of a text as sorted 64-bit hashes; hashes of words are kept while they recur."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            out = _mix(out * _M + h[j : len(h) - n + 1 + j])
        return np.unique(_mix(out + np.uint64(n)))


def minima(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, (low[at : at + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def _bands(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _M
    for j in range(ROWS):
        key = _mix(key * _M + rows[:, j])
    return key.view(np.int64)


def _codes(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum (stirred, as minima are small numbers), packed into longs."""
    low = _mix(m.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(CODES, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(-1, CODES) << shifts, axis=1).view(np.int64)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, same (128 bits of the set), bands, codes and marks (32 bits of each band) of each row."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64())), ("codes", pa.list_(pa.int64())), ("marks", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for b in batches:
            rows = []
            for t in b["text"].to_pylist():
                s = shingles(t)
                if len(s):
                    m = minima(s)
                    bands = _bands(m)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), bands, _codes(m), bands.astype("<u4").tobytes()))
                else:
                    rows.append((0, None, None, None, None))
            n_, same, bands, codes, marks = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_shingles": n_, "same": same, "bands": bands, "codes": codes, "marks": marks}, schema=schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return plain.mapInArrow(made, "doc_id long, n_shingles long, same binary, bands array<long>, codes array<long>, marks binary")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the packed codes: share of equal codes, corrected for chance collisions."""
    ones = sum(1 << (BITS * i) for i in range(CODES))
    differ = F.lit(0)
    for i in range(HASHES // CODES):
        x = a[i].bitwiseXOR(b[i])
        any_ = x
        for s in range(1, BITS):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(any_.bitwiseAND(F.lit(ones)))
    chance = 1 / 2**BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for all rows of a against all of b."""
    ones = np.uint64(sum(1 << (BITS * i) for i in range(CODES)))
    differ = np.zeros((len(a), len(b)), np.int32)
    for i in range(a.shape[1]):
        x = a[:, i, None] ^ b[None, :, i]
        any_ = x
        for s in range(1, BITS):
            any_ = any_ | (x >> np.uint64(s))
        differ += np.bitwise_count(any_ & ones)
    chance = 1 / 2**BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents that ids(doc_id) asks for, and of few others: the scan is thinned by a table of at most ID_BUCKETS rows, so that other texts don't move."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS))
    asked = ids.select(bucket.alias("_bucket")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("_bucket", bucket)
    return texts.join(F.broadcast(asked), "_bucket", "left_semi").drop("_bucket")


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar: 100 * intersection >= percent * union."""
    texts = _texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, mine = Shingles(n), None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist()):
                if y != last:  # rows of one hub come together
                    last, mine = y, shingles(y)
                other = shingles(x)
                common = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(mine) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(linked, "a long, b long").distinct()


def _shingle_bytes(n: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, schema = Shingles(n), pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
        for b in batches:
            yield pa.RecordBatch.from_pydict({"node": b["doc_id"], "shingles": [shingles(t).tobytes() for t in b["text"].to_pylist()]}, schema=schema)

    return made


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, component (the smallest node reachable), of all nodes in links.

    Every node takes the smallest label around it, then its label's label, until none changes; each
    round is a written table.
    """
    spark = links.sparkSession
    edges = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("_near"))
        stepped = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_label"))
        jump = labels.select(F.col("node").alias("_label"), F.col("component").alias("_jump"))
        found = stepped.join(jump, "_label", "left").select("node", "_old", F.least("_label", F.coalesce("_jump", "_label")).alias("component"))
        found = written(found, "labels")
        labels = found.select("node", "component")
        if found.filter("component <> _old").isEmpty():
            return labels


def _open_members(in_buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components: key, node, n and part, the component."""
    label = F.coalesce("component", "node")
    labelled = in_buckets.filter("n > 2").join(parts, "node", "left").select("key", "node", "n", label.alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).filter("_low < _high").select("key")
    return labelled.join(mixed, "key", "left_semi")


_PACKED = ("node", "part", "codes", "marks", "n_shingles")


def _packs(members: DataFrame, blocks: Column, *more: str) -> DataFrame:
    """Members of a bucket in packs, with every other pack of their bucket beside them where there are several: key, mine, theirs (null: mine)."""
    packs = members.withColumn("blocks", F.greatest(blocks, F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    packs = packs.groupBy("key", "blocks", "block").agg(F.collect_list(F.struct(*_PACKED, *more)).alias("mine"))
    alone = packs.select("key", "mine", F.lit(None).cast(packs.schema["mine"].dataType).alias("theirs"))
    several = packs.filter("blocks > 1")
    pairs = several.join(several.select("key", F.col("block").alias("block2"), F.col("mine").alias("theirs")), "key").filter("block < block2")
    return alone.unionByName(pairs.select("key", "mine", "theirs"))


class _Pack:
    def __init__(self, members: pa.StructArray):
        col = lambda name, width: np.frombuffer(b"".join(members.field(name).to_pylist()), f"<u{width}")
        self.members = members
        self.node, self.part, self.size = (members.field(c).to_numpy() for c in ("node", "part", "n_shingles"))
        codes = members.field("codes")
        self.codes = codes.flatten().to_numpy().view(np.uint64).reshape(len(self.node), -1)
        self.marks = col("marks", 4).reshape(len(self.node), BANDS)
        if members.type.get_field_index("shingles") >= 0:
            self.sets = [np.frombuffer(x, np.uint64) for x in members.field("shingles").to_pylist()]

    def likely(self, other: _Pack, key: int, least: float, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the pairs of different components that may be similar and share no band before that of this key."""
        band = np.uint32(key & 0xFFFFFFFF)
        for at in range(0, len(self.node), SLICE):
            part = slice(at, at + SLICE)
            near = _estimates(self.codes[part], other.codes) >= least
            near &= self.part[part, None] > other.part if self is other else self.part[part, None] != other.part
            short, long = np.minimum(self.size[part, None], other.size), np.maximum(self.size[part, None], other.size)
            i, j = np.nonzero(near & (100 * short >= percent * long))
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)] + at, j[k : k + (1 << 16)]
                first = (self.marks[x] == other.marks[y]).argmax(axis=1)
                own = self.marks[x, first] == band
                yield x[own], y[own]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Pack, _Pack]]:
    for b in batches:
        mine, theirs = b["mine"], b["theirs"]
        for k, key in enumerate(b["key"].to_pylist()):
            one = _Pack(mine[k].values)
            yield key, one, _Pack(theirs[k].values) if theirs[k].is_valid else one


_MEMBER = "key long, node long, part long, codes array<long>, marks binary, n_shingles long"


def _with_partners(least: float, percent: int):
    """The members that have a likely partner in another component."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, one, other in _opened(batches):
            places = list(one.likely(other, key, least, percent))
            for pack, found in ((one, [i for i, _ in places]), (other, [j for _, j in places])):
                at = np.unique(np.concatenate(found)) if found else ()
                if len(at):
                    rows = pack.members.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), *(rows.field(c) for c in _PACKED)], names=["key", *_PACKED])

    return compared


def _forest(least: float, percent: int):
    """Links between components by full sets: those that join what is still apart in the task's pair of packs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, one, other in _opened(batches):
            above: dict[int, int] = {}

            def root(x: int) -> int:
                while above.get(x, x) != x:
                    x = above[x]
                return x

            links = []
            for i, j in one.likely(other, key, least, percent):
                rows, at_i = np.unique(i, return_inverse=True)
                cols, at_j = np.unique(j, return_inverse=True)
                near = np.zeros((len(rows), len(cols)), bool)
                near[at_i, at_j] = True
                common = _common([one.sets[k] for k in rows], [other.sets[k] for k in cols], near)[at_i, at_j]
                sizes = np.array([len(one.sets[k]) for k in rows])[at_i] + np.array([len(other.sets[k]) for k in cols])[at_j]
                linked = 100 * common >= percent * (sizes - common)
                for x, y in zip(i[linked].tolist(), j[linked].tolist()):
                    low, high = sorted((root(int(one.part[x])), root(int(other.part[y]))))
                    if low != high:
                        above[high] = low
                        links.append((int(one.node[x]), int(other.node[y])))
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return compared


def _common(sets_a: list[np.ndarray], sets_b: list[np.ndarray], near: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the near pairs: pair by pair, or by products of 0/1 matrices over the shingles of both sides where that is less work."""
    out = np.zeros(near.shape, np.int64)
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return out
    own = lambda sets, at: (np.concatenate([sets[i] for i in at]), np.repeat(np.arange(len(at)), [len(sets[i]) for i in at]))
    (va, ra), (vb, rb) = own(sets_a, rows), own(sets_b, cols)
    both = np.intersect1d(va, vb)
    if near.sum() * 15e-6 < len(rows) * len(cols) * len(both) / 1.5e10:
        for i, j in zip(*np.nonzero(near)):
            out[i, j] = len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True))
        return out
    found = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, len(both), 4096):
        some = both[at : at + 4096]
        sides = []
        for v, r, n in ((va, ra, len(rows)), (vb, rb, len(cols))):
            place = np.minimum(np.searchsorted(some, v), len(some) - 1)
            hit = some[place] == v
            m = np.zeros((n, len(some)), np.float32)
            m[r[hit], place[hit]] = 1
            sides.append(m)
        found += sides[0] @ sides[1].T
    out[np.ix_(rows, cols)] = np.rint(found).astype(np.int64)
    return out


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id and kept for each row.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer than n words
    has its whole sequence as one shingle. Documents whose sets are similar (100 * intersection >=
    percent * union) are linked; component_id is the smallest doc_id reachable, kept tells that it is
    the own one. Null, empty and blank texts have no shingles and are linked with nothing. A null
    doc_id is linked with nothing either: its component_id is null, and it is kept. Repeated rows are
    in one component; rows that share an id count as one document with several texts. Ties are none: a
    component has one smallest id. Very long texts are compared whole; an empty table gives no rows, and
    other columns of docs, whatever their names, are not read.
    """
    sigs = written(signatures(docs, n), "signatures")
    live = sigs.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    kept = (F.first(c).alias(c) for c in ("bands", "codes", "marks", "n_shingles"))
    classes = written(live.groupBy("same").agg(F.min("doc_id").alias("node"), *kept), "classes")
    members = classes.select("node", F.explode("bands").alias("key"))
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    in_buckets = written(members.join(hubs, "key"), "members")
    codes, least = classes.select("node", "codes"), percent / 100 - MARGIN

    pairs = in_buckets.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    held = pairs.join(codes.toDF("a", "codes_a"), "a").join(codes.toDF("b", "codes_b"), "b")
    stars = written(held.filter(estimate(F.col("codes_a"), F.col("codes_b")) >= least).select("a", "b"), "stars")
    links = written(confirmed(stars, docs, n, percent), "star-links")
    parts = components(links)

    # What the stars leave open: who has likely partners elsewhere, then these with their full sets.
    open_ = _open_members(in_buckets, parts).join(classes.select("node", "codes", "marks", "n_shingles"), "node")
    partners = _packs(open_, F.ceil(F.col("n") / BLOCK)).mapInArrow(_with_partners(least, percent), _MEMBER).dropDuplicates(["key", "node", "marks"])
    partners = written(partners, "partners")
    ids = partners.select(F.col("node").alias("doc_id")).distinct()
    sets = _texts_of(docs, ids).join(ids, "doc_id", "left_semi").mapInArrow(_shingle_bytes(n), "node long, shingles binary")
    weight = partners.groupBy("key").agg(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") * 8 / BLOCK_BYTES).alias("weight"))
    packs = _packs(partners.join(weight, "key").join(sets, "node"), F.ceil("weight"), "shingles")
    joins = written(packs.mapInArrow(_forest(least, percent), "a long, b long").distinct(), "links")
    # These links join whole components.
    label = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
    joins = joins.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    wider = components(joins).toDF("_node", "_wider")
    every = parts.unionByName(joins.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").withColumn("component", F.col("node")))
    final = every.join(wider, every["component"] == wider["_node"], "left").select("node", F.coalesce("_wider", "component").alias("component"))

    by_class = classes.select("same", "node").join(final, "node", "left").select("same", F.coalesce("component", "node").alias("_component"))
    known = sigs.select("doc_id", "n_shingles", "same").join(by_class, "same", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("_component", "doc_id")).cast("long")
    return known.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one document of each group of near-duplicates: that of the smallest doc_id.

    Documents without shingles (null, empty and blank texts) and rows without an id stay. Rows that share an id
    are one document: one of them stays, the first by a hash of its text and the text, and none if one of its
    texts is linked to a smaller id. Very long texts are compared whole; an empty table stays empty. All
    columns stay as they are, whatever their names.
    """
    found = written(near_duplicates(docs, n, percent), "near-duplicates").filter(F.col("doc_id").isNotNull())
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    again = found.filter("kept").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    # Rows whose bucket of ids has none to go stay where they are; only the others meet the table of those that go.
    bucket = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(ID_BUCKETS))
    buckets = F.broadcast(gone.select(bucket(F.col("doc_id")).alias("bucket")).distinct())  # at most ID_BUCKETS rows
    hit = bucket(docs["doc_id"]) == buckets["bucket"]
    sure, maybe = docs.join(buckets, hit, "left_anti"), docs.join(buckets, hit, "left_semi")
    kept = sure.unionByName(maybe.join(gone, maybe["doc_id"].cast("long") == gone["doc_id"], "left_anti"))
    if again.isEmpty():
        return kept
    same_id = kept["doc_id"].cast("long") == again["doc_id"]
    order = F.struct(F.xxhash64("text"), F.col("text"))
    once = kept.join(again, same_id, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in kept.columns)), order).alias("row"))
    return kept.join(again, same_id, "left_anti").unionByName(once.select("row.*"))


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), n=2, percent=80)
