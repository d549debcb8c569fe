"""Each operator against brute force, an exact round trip or held-out labels, and on odd tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import same
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from presslight.llm import bpe, chat, eliasfano, imatch, knn, lm, minhash, mixing, pieces, quality, registry, sharding, tokenfile
from presslight.llm.pieces import PieceEncoder

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DDL = "doc_id long, text string, source string, size long, score double"
LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [
    (1, "the cat sat on the mat by the door", "a", None, 1.0),
    (1, "the cat sat on the mat by the door", "a", None, 1.0),
    (2, None, None, 5, None),
    (3, "", "b", 5, None),
    (4, " \t\n ", "b", None, None),
    (None, "the cat sat on the mat by the door", "a", None, None),
    (5, LONG, "c", None, None),
    (6, "THE CAT sat on the mat by the door", "", None, None),
    (7, "one", "c", None, None),
    (8, "été ﬁn 世界 \x1c\x85 x<|endoftext|>y", "ü", None, None),
    (9, LONG + "end", "c", None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck.sql(registry.SQL[name]))


CLASHING = ["weight", "level", "budget", "_key", "_slice", "_source", "_at", "_start", "_h", "_row", "_number", "_bucket", "bucket", "row", "rows", "held_out", "predicted", "size", "copies", "taken", "shard", "slot"]


def test_all_on_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    key = lambda i, x: (i is None, i or 0, str(x))
    texts = sorted(((i, t or "") for i, t, *_ in ODD), key=lambda r: key(*r))

    sizes = {(i, t): len(words(t)) for i, t, *_ in ODD}
    mixed = mixing.mix_sources(odd).collect()
    assert sorted(r["size"] for r in mixed) == sorted(len(words(t)) for _, t, *_ in ODD) and all(r["size"] == sizes[r["doc_id"], r["text"]] for r in mixed)
    by_source = Counter()
    for i, t, s, *_ in ODD:
        by_source[s] += len(words(t))
    assert all(r["source_size"] == by_source[r["source"]] and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in mixed)

    dealt = sharding.shard_documents(odd, 8).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in dealt) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in ODD)
    assert len({r["shard"] for r in dealt if not r["text"]}) == 1 and len({(r["shard"], r["slot"]) for r in dealt}) == len(ODD)

    scored = {(r["doc_id"], r["text"]): r["score"] for r in quality.score_documents(odd, model).collect()}
    for (_, t), score in scored.items():
        at, n = quality.bag(t or "")
        assert score == pytest.approx(model.score(float((model.weights[at] * n).sum()), int(n.sum())))
    assert scored[2, None] == scored[3, ""] == scored[4, " \t\n "] == model.score(0.0, 0)

    marked = sorted((r["doc_id"], r["n_chars"]) if r["doc_id"] is not None else (99, r["n_chars"]) for r in imatch.fingerprints(odd).collect())
    assert marked == sorted((99 if i is None else i, len(t)) for i, t in texts)
    assert {r["fingerprint"] for r in imatch.fingerprints(odd).filter("doc_id in (2, 3, 4)").collect()} == {"0" * 8 * imatch.SUBSETS}

    tokenizer = Tokenizer.from_file(WORD_BPE)
    assert sorted((r["n_tokens"], r["ids_sha256"]) for r in bpe.encoded(odd, WORD_BPE).collect()) == sorted(expected_bpe(tokenizer, t)[:2] for _, t in texts)

    told = lm.score_texts(odd).collect()
    assert Counter(r["n_tokens"] for r in told) == Counter(len(words(t)) + 1 for _, t in texts) and all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in told)

    files = tokenfile.read_documents(tokenfile.token_files(odd, BYTE_BPE)).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    lengths = [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts]
    assert [(r["doc_id"], r["n_tokens"], r["start"]) for r in files] == [(i, n, sum(lengths[:k])) for k, ((i, _), n) in enumerate(zip(texts, lengths))]

    for f in (mixing.mix_sources, sharding.shard_documents, lambda d: quality.score_documents(d, model), imatch.fingerprints, minhash.near_duplicates, minhash.deduplicated, mixing.mixed_documents, lambda d: bpe.encoded(d, WORD_BPE), lm.score_texts, lambda d: tokenfile.read_documents(tokenfile.token_files(d, BYTE_BPE))):
        assert f(empty).count() == 0
    assert quality.fit(empty, labels.limit(0)).score(0.0, 0) == 0.5


def test_columns_that_clash(spark, odd):
    wide = odd.select("doc_id", "text", "source", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING))
    told = lambda r, names: all(r[c] == f"{c}={'-' if r['doc_id'] is None else r['doc_id']}" for c in names)
    mixed = mixing.mix_sources(wide).collect()
    assert len(mixed) == len(ODD) and all(told(r, [c for c in CLASHING if c not in mixing.ADDED]) for r in mixed)
    plain = mixing.mix_sources(odd)
    assert sorted((r["size"], r["taken"]) for r in mixed) == sorted((r["size"], r["taken"]) for r in plain.collect())
    dealt = sharding.shard_documents(wide).collect()
    assert len(dealt) == len(ODD) and all(told(r, [c for c in CLASHING if c not in ("size", "shard", "slot")]) for r in dealt)
    model = quality.fit(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    for out in (mixing.mixed_documents(wide), minhash.deduplicated(wide), quality.good_documents(wide, model, 0.0)):
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(told(r, CLASHING) for r in rows)
    # Ids 1 and 6 say the same but for case, and 1 stands twice; the two long texts are alike.
    assert sorted(r["doc_id"] or 0 for r in minhash.deduplicated(wide).collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


# 1

def test_mix_near_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 20), f"s{i % 5 if i % 3 else 0}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df).toPandas()
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] % out["size"] == 0).all()
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 20).all() and (by["target"] <= 3 * by["size"]).all()
    again = mixing.mix_sources(df.repartition(7)).toPandas()
    assert out.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert mixing.mixed_documents(df).count() == (out["taken"] // out["size"]).sum()


def test_mix_with_given_weights(spark):
    df = spark.createDataFrame([(i, "w w", "ab"[i % 2]) for i in range(100)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1)], "source string, weight int")
    by = dict(mixing.mix_sources(df, weights, share=0.5).groupBy("source").agg(F.sum("taken")).collect())
    assert by == {"a": 50 * 2 // 2, "b": 0}


# 2

def expected_bpe(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_bpe_is_the_librarys(spark, docs, path):
    rng = np.random.default_rng(5)
    letters = list("abc de'sf g\n\t ́\x1c\x85　ÀİΣß1234!?,") + ["<|endoftext|>"]
    base = ["".join(rng.choice(letters, rng.integers(0, 900))) for _ in range(20)]
    texts = ["".join(base[k] for k in rng.integers(0, 20, rng.integers(0, 6))) for _ in range(60)] + ["x" * 5000, "a" * 3000 + " b", None, "", " \n "]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in docs[:60]] * 2
    tokenizer = Tokenizer.from_file(path)
    got = bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted((i, *expected_bpe(tokenizer, t)) for i, t in rows)


def test_chunks_depend_on_content():
    rng = np.random.default_rng(4)
    a = " ".join("".join(rng.choice(list("etaoin"), rng.integers(1, 9))) for _ in range(4000))
    one, two = bpe._chunks(a.encode()), bpe._chunks(("a new start, " + a).encode())
    assert b"".join(one) == a.encode() and len(set(one) & set(two)) >= len(one) - 2 and len(one) > 10


def test_pieces_are_the_librarys():
    for path in (WORD_BPE, BYTE_BPE):
        e, t = PieceEncoder(path), Tokenizer.from_file(path)
        for text in ["a  b \n\n  c", " x", "x ", "\n", "it's <|endoftext|> ok", "a  b", LONG[:100]]:
            ids, shown = e.encode_and_show([text])[0]
            want = t.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and shown.decode() == t.decode(want, skip_special_tokens=False)


# 3

def test_white_space_that_crowds():
    """The plain searches agree with the pattern for every pair and single of white space, marks and letters."""
    some = [c for c in map(chr, range(0x3100)) if c.isspace()] + ["\0", "a", "é", "世", "!"]
    texts = ["", *some, *(f"{x}{a}{b}{y}" for a in some for b in some for x in ("", "w") for y in ("", "w"))]
    for text in texts:
        assert pieces._beside(text) == (pieces._BESIDE.search(text) is not None), repr(text)
    assert not any(c.isspace() for c in map(chr, range(0x3001, 0x110000)))


def test_pieces_across_generations(monkeypatch):
    """A cache that turns over before every batch gives the library's ids, for pieces met in both generations or new."""
    monkeypatch.setattr(pieces, "KEPT", 3)
    batches = [[t for _, t, *_ in ODD if t and t != LONG], ["the cat sat", "one two, three! été"], ["the dog, sat!", "one\ntwo  three"], ["", "the cat\u3000sat"]]
    for path in (WORD_BPE, BYTE_BPE):
        e, t = PieceEncoder(path), Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        for texts in batches + batches[::-1]:
            ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
            assert [np.frombuffer(i, "<u4").tolist() for i in e.encode(texts)] == ids
            assert [shown.decode() for _, shown in e.encode_and_show(texts)] == [t.decode(i, skip_special_tokens=False) for i in ids]


def test_pieces_that_start_with_a_zero_byte():
    """A zero byte after a space is text, not the mark of a piece without one."""
    for path in (WORD_BPE, BYTE_BPE):
        e, t = PieceEncoder(path), Tokenizer.from_file(path)
        for text in ["a \0 b", "a \0b", "\0", "\0a", " \0", "a \0\0 \0", "a\0 b"]:
            assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_are_looked_up_once_a_batch(monkeypatch):
    """However often a piece recurs in a batch it is looked up once, and byte-level words meet the library's model many in a call; ids stay the library's."""
    texts = ["", "the cat, the cat; the cat", " the dog\nthe dog, été", "\n", " ", "x ", "\nthe\n", "ÿ þ <|endoftext|> \0 a  b", "it's the CAT's 12 cats!", "", "\u3000 the\u0301 ﬁn 世界"]
    texts += [" ".join(f"{a}{b}{c}{m}" for a in "abcdé" for b in "abcdefghij" for c in "aeiouy" for m in ("", ",", ".")) * 20]
    looked_up, apart = [], []
    learn, tokenized = PieceEncoder.learn, PieceEncoder._tokenized
    monkeypatch.setattr(PieceEncoder, "learn", lambda self, keys: learn(self, keys if looked_up.append(keys := list(keys)) else keys))
    monkeypatch.setattr(PieceEncoder, "_tokenized", lambda self, words: apart.append(len(words)) or tokenized(self, words))
    for path in (WORD_BPE, BYTE_BPE):
        looked_up.clear(), apart.clear()
        e, t = PieceEncoder(path), Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert [np.frombuffer(i, "<u4").tolist() for i in e.encode(texts)] == want
        assert [len(k) for k in looked_up] == [len(set(looked_up[0]))] and len(looked_up[0]) > 900
        assert [np.frombuffer(i, "<u4").tolist() for i in e.encode(texts[::-1])] == want[::-1]
        assert e.encode([]) == [] and e.encode(["", ""]) == [b"", b""]
    assert apart == []  # of the byte-level tokenizer


def test_quality_on_held_out_labels(spark):
    path = SF.replace("sf0.001", "sf0.01")
    got = registry.QUERIES["op3_quality_classifier"](spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


# 4

def test_shards_are_minimax(spark):
    for seed, big in ((1, 40), (2, 4000)):
        rng = np.random.default_rng(seed)
        texts = ["t" * int(n) for n in rng.integers(0, big, 300)] + ["copy"] * 50
        out = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).toPandas()
        groups = {}
        for t in texts:
            h = int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
            groups[h] = groups.get(h, 0) + len(t) + 1
        sizes = [groups[h] for h in sorted(groups)]

        def fits(c):
            n, used = 1, 0
            for s in sizes:
                n, used = (n, used + s) if used + s <= c else (n + 1, s)
            return max(sizes) <= c and n <= 8

        best = next(c for c in range(max(max(sizes), -(-sum(sizes) // 8)), sum(sizes) + 1) if fits(c))
        assert out.groupby("shard")["size"].sum().max() == best
        assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
        assert out.groupby("text")["shard"].nunique().max() == 1
        assert (out["text_crc32"] == [zlib.crc32(t.encode()) for t in out["text"]]).all()


# 5

def test_fingerprints(spark, docs):
    got = registry.QUERIES["op5_document_fingerprints"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    for k, (i, t) in enumerate(docs):
        e = imatch.edited(t, docs[(k + 1) % len(docs)][1])
        assert got["n_chars"][k] == len(t) and got["edited_sha256"][k] == hashlib.sha256(e.encode()).hexdigest()
    by_text = {}
    for (i, t), f in zip(docs, got["fingerprint"]):
        assert by_text.setdefault(t, f) == f
    assert got["near_edited"].mean() > 0.15 > 0.05 > got["near_next"].mean()
    # Band, fingerprint and likeness by brute force.
    df = Counter(w for _, t in docs for w in set(t.encode().lower().split()))
    inside = {w for w, n in df.items() if 2 <= n <= max(imatch.ALWAYS, len(docs) // 20)}

    def marks(text):
        words = set(text.encode().lower().split())
        out = []
        for k, (rate, count) in enumerate(imatch.RATES):
            before = math.prod(r for r, _ in imatch.RATES[:k])
            for slot in range(count):
                own = [w for w in sorted(words & inside or words) if xxhash.xxh3_128_intdigest(w, 5) // before % rate == slot]
                out.append((xxhash.xxh32_intdigest(b"\n".join(own)) or 1) if own else 0)
        return out

    def alike(a, b):
        told = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in told) / len(told) if told else 1.0

    for k in range(0, len(docs), 9):
        mine, following = docs[k][1], docs[(k + 1) % len(docs)][1]
        new = marks(imatch.edited(mine, following))
        assert got["fingerprint"][k] == "".join("%08x" % x for x in marks(mine)) and got["edited_fingerprint"][k] == "".join("%08x" % x for x in new)
        assert got["near_edited"][k] == alike(marks(mine), new) and got["near_next"][k] == alike(marks(mine), marks(following))


def test_band_is_counted_by_term(spark):
    often, rare, single = "often", "rare", [(f"a{k}", f"b{k}") for k in range(7)]
    # Odd words don't count, and do not tell copies apart.
    shared = "some words that three texts share"
    texts = [shared, shared + "".join(" " + a for a, _ in single), shared + "".join(" " + b for _, b in single)]
    texts = [f"{t} {often} {rare}" for t in texts] + [f"{often} {k}" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Counter(w for t in texts for w in imatch.terms(t))
    assert imatch.band_terms(df).tolist() == sorted(xxhash.xxh3_64_intdigest(w) for w, n in counts.items() if 2 <= n <= imatch.ALWAYS)
    assert imatch.band_terms(df.limit(0)).tolist() == []
    assert len({r["fingerprint"] for r in imatch.fingerprints(df).filter("doc_id < 3").collect()}) == 1


# 6

def test_top_k_with_ties_and_odd_vectors(spark):
    rows = [(i, [0.5, float(i % 3)]) for i in range(60)] + [(60, None), (61, [1.0, None]), (62, [float("nan"), 1.0]), (63, [float("inf"), 1.0]), (None, [1.0, 1.0]), (64, [2.0]), (65, [])]
    rows += [(0, [0.5, 0.0])] + [(1, [0.5, 2.0])] * 3 + [(20, [0.5, 1.0]), (20, [1.0, 2.0])]  # repeated rows and ids
    v = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in knn.top_k(v, F.col("vec_id") % 20 == 0, 20).collect()]
    clean = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and i not in (60, 61, 62, 63)]
    want = []
    for k, (q, x) in enumerate(clean):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for j, (c, y) in enumerate(clean) if j != k)[:20]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    assert knn.top_k(v.limit(0), F.lit(True)).count() == 0


def test_products_stay_exact():
    big = np.array([[2**40, 3]], dtype=np.int64)
    assert knn._products(big, np.array([[2**20, 1]], dtype=np.int64))[0, 0] == 2**60 + 3


def test_a_source_listed_twice_doubles_no_document(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", "x"), (3, "f", "y")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "source string, weight int")
    once = spark.createDataFrame([("x", 2), ("y", 2)], "source string, weight int")
    made = lambda w: sorted((r["doc_id"], r["target"], r["taken"]) for r in mixing.mix_sources(df, weights=w).collect())
    assert len(made(weights)) == 3 and made(weights) == made(once)


# 7

def test_language_model_by_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_lm_scoring"](spark, SF).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    ones, twos, starts = Counter(), Counter(), 0
    for i, t in docs:
        if not held(i):
            w = words(t) + [b""]
            ones.update(w)
            twos.update(zip([None, *w], w))
            starts += 1
    n, v = sum(ones.values()), len(ones)
    for i, t in docs:
        w = words(t) + [b""]
        p1 = lambda x: (ones[x] + 1) / (n + v + 1)
        c1 = lambda x: starts if x is None else ones[x]
        base = sum(math.log10(p1(x)) for x in w)
        score = sum(math.log10((twos[a, b] + lm.MU * p1(b)) / (c1(a) + lm.MU)) for a, b in zip([None, *w], w))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(x in ones for x in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, abs=0.03 * len(w))
    gain = [(r["score"] - r["base_score"]) / r["n_tokens"] for i, r in got.items() if held(i)]
    assert np.mean(gain) > 0


def test_language_model_is_exact_for_frequent_words(spark):
    # Counts just below the next class, far above 64, as contexts and as successors.
    texts = ["alpha beta " * 1040 + "gamma delta " * 37, "beta alpha " * 33 + "delta alpha gamma " * 90, "alpha beta gamma delta " * 25, "unheard alpha beta delta"]
    rows = [(i, texts[i % 4]) for i in range(23)] + [(100 + i, "alpha") for i in range(130)]
    got = {r["doc_id"]: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ones, twos, starts = Counter(), Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = words(t) + [b""]
            ones.update(w)
            twos.update(zip([None, *w], w))
            starts += 1
    assert sum(c > 1000 and c not in lm.CLASS_LEAST for c in ones.values()) >= 2
    everything = sum(ones.values()) + len(ones) + 1
    for i, t in rows:
        w = words(t) + [b""]
        score = 0.0
        for a, b in zip([None, *w], w):
            c, p1 = starts if a is None else ones[a], (ones[b] + 1) / everything
            score += math.log10((twos[a, b] + lm.MU * p1) / (c + lm.MU)) if c else math.log10(p1)
        assert got[i]["score"] == pytest.approx(score, abs=(0.5 / lm.STEPS + 1e-6) * len(w))


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in [(0, 1), (1, 5), (1000, 10), (1000, 10**6), (500, 2**40), (7, 2**63)]:
        v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        e = eliasfano.EliasFano.of(v)
        assert (e.access(np.arange(n)) == v).all()
        if n:
            x = rng.integers(0, top, 500).astype(np.uint64)
            ends = np.sort(rng.integers(0, n + 1, (500, 2)), axis=1)
            assert (e.successor(x, ends[:, 0], ends[:, 1]) == np.clip(np.searchsorted(v, x), ends[:, 0], ends[:, 1])).all()
    pairs = np.unique(rng.integers(0, [30, 500], (2000, 2)), axis=0)
    trie = eliasfano.Trie.build(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    asked = rng.integers(0, [35, 520], (5000, 2))
    at = {tuple(p): k for k, p in enumerate(pairs.tolist())}
    assert (trie.find(asked[:, 0], asked[:, 1]) == [at.get(tuple(p), -1) for p in asked.tolist()]).all()
    assert (trie.codes == np.arange(len(pairs))).all()


# 8

def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more <|im_end|>"), (None, None)]
    rows = [(c, k, *turns[k]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (6, 3)) for k in range(n)] + [(5, 0, "user", "other"), (None, 0, "user", "lone"), (2, 0, "user", "hi")]
    out = {r["conv_id"]: r for r in chat.render_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {2, 5, None} and out[2]["copies"] == 2 and out[2]["n_turns"] == 4
    assert out[2]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore <im_end|><|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"
    long = spark.range(5000).selectExpr("1 AS conv_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    parts = sorted(chat.render_chats(long).collect(), key=lambda r: r["first_position"])
    assert len(parts) == 5 and "".join(r["rendered"] for r in parts).count("<|im_start|>") == 5000


# 9

def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


@pytest.mark.parametrize("n", [2, 5])
def test_components_by_brute_force(spark, docs, n):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    rows = list(docs)
    for k in range(150):  # a chain and a cloud of edits, some of them far from the base
        edit = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 12)):
            edit[at] = f"e{rng.integers(0, 9)}"
        rows.append((10_000 + k, " ".join(edit)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, 80).collect()
    want = brute_components(rows, n, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = {}
    for r in minhash.near_duplicates(odd, 2).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[1] == {(8, 1, True)} and got[6] == {(8, 1, False)} and got[2] == {(0, 2, True)} and got[3] == {(0, 3, True)} and got[7] == {(1, 7, True)}
    assert got[None] == {(8, None, True)} and got[9] == {(6, 5, False)}  # five of six shingles
    kept = minhash.deduplicated(odd, 2).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, None])) and len(kept[0]) == 5


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        common = int(1000 * share)
        a, b = pool[:1000], np.concatenate([pool[:common], pool[1000 : 2000 - common]])
        true = common / (2000 - common)
        ca, cb = (minhash._codes(minhash.minima(np.unique(x))).view(np.uint64)[None] for x in (a, b))
        assert abs(minhash._estimates(ca, cb)[0, 0] - true) < 0.17


def test_intersections_of_packs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 200)).astype(np.uint64) for _ in range(60)]
    for near in (np.ones((40, 60), bool), rng.random((40, 60)) < 0.002, np.zeros((40, 60), bool)):
        want = np.array([[len(np.intersect1d(a, b)) if n else 0 for b, n in zip(sets, row)] for a, row in zip(sets[:40], near)])
        got = minhash._common(sets[:40], sets, near)
        assert (got[near] == want[near]).all()


# 10

def test_token_files_round_trip(spark, docs):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in registry.QUERIES["op10_token_files"](spark, SF).collect()}
    tokenizer, start = Tokenizer.from_file(BYTE_BPE), 0
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_any_id_by_rank():
    rng = np.random.default_rng(1)
    ids = rng.choice([3, 255, 256, 65535, 65536, 1 << 24, 4294967295, 50000], 5000).astype(np.uint32)
    s = tokenfile.Segment(tokenfile.pack(ids, [1, None, 2], [1000, 0, 4000]))
    at = rng.integers(0, 5000, 3000)
    assert (s.ids() == ids).all() and (s.at(at) == ids[at]).all() and s.starts.tolist() == [0, 1000, 1000, 5000]
    none = tokenfile.Segment(tokenfile.pack(np.zeros(0, np.uint32), [], []))
    assert len(none.ids()) == 0 and len(none.at(np.zeros(0, int))) == 0
