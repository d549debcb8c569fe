"""Collocations against brute force on texts with hot words, ties, odd rows and long pieces."""

import random
import re
from collections import Counter, defaultdict

import pandas as pd

from presslight.llm import collocations

DDL = "doc_id long, text string, lang string, h long, w1 string, n int, word string"


def brute(rows, least, percent, top):
    totals, counts = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and percent * a <= 100 * b and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def made(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], DDL)
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


def texts(n, rng):
    vocabulary = ["the", "of", "New", "york", "TIMES", "square", "été", "İstanbul", "x\x1cy", "\xa0", "K", "a-b"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(30))
        marks = rng.choices([" ", "  ", "\t", ", ", ". ", "\n", "!"], [20, 2, 1, 2, 2, 1, 1], k=len(words))
        yield i, "".join(w + m for w, m in zip(words, marks)), rng.choice(["en", "en", "fr", None, ""])


def test_equals_brute_force(spark):
    rows = list(texts(400, random.Random(3)))
    for how in ({"least": 5, "percent": 80, "top": 40}, {"least": 2, "percent": 50, "top": 2000}):
        assert made(spark, rows, **how) == brute(rows, **how)


def test_full_tables_change_no_count(spark, monkeypatch):
    """Where every slot is taken, every word and pair seems frequent; only the work grows."""
    monkeypatch.setattr(collocations, "bit_table", lambda hashes: b"\xff" * (collocations.TABLE_BITS // 8))
    rows = list(texts(150, random.Random(4)))
    how = {"least": 4, "percent": 80, "top": 100}
    assert made(spark, rows, **how) == brute(rows, **how)


def test_slices_and_runs_change_nothing(monkeypatch):
    """The workers' functions, called here, over texts cut where pieces end and flushed often."""
    rng = random.Random(6)
    pdf = pd.DataFrame([(lang or "und", text) for _, text, lang in texts(200, rng)], columns=["lang", "text"])

    def all_of():
        counts, ids = Counter(), defaultdict(list)
        for out in collocations._word_counts(iter([pdf])):
            for lang, word, n in out.itertuples(index=False):
                counts[lang, word] += n
        for lang, found in collocations._hashed(iter([pdf])):
            ids[lang] += found.tolist()
        packed = {lang: [x for i, x in enumerate(v) if x or (i and v[i - 1])] for lang, v in ids.items()}  # empty pieces don't count
        return counts, packed

    whole = all_of()
    monkeypatch.setattr(collocations, "SLICE", 20)
    monkeypatch.setattr(collocations, "RUN", 50)
    monkeypatch.setattr(collocations, "REMEMBERED", 5)
    assert all_of() == whole and sum(whole[0].values()) == sum(x > 0 for v in whole[1].values() for x in v)


def test_odd_rows_and_empty_table(spark):
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n..", "en"), (4, "one", "en"), (None, "Red Car " * 30_000, "en"), (5, "Red Car", None), (5, "Red Car", None), (6, "red car! red\ncar", "und")]
    how = {"least": 2, "percent": 80, "top": 2000}
    assert made(spark, rows, **how) == brute(rows, **how)
    assert made(spark, [], least=2) == []
    assert made(spark, [(1, None, None)], least=2) == []
