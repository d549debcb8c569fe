"""The prefix trie against brute force, with blocks of any size, and on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pandas as pd
import pytest

from presslight.llm import trie

DDL = "conv_id long, turn long, role string, text string, key string, block int, path string"


def brute(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    convs = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            convs[r[0]].append(r)
    convs = {c: [(r[2] or "", r[3] or "") for r in sorted(rs, key=order)] for c, rs in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        found, todo = [], [p]
        while todo:
            found.append(todo.pop())
            todo += kids[found[-1]]
        return found

    out = []
    for p, m in members.items():
        sub = below(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), sum(not kids[q] for q in sub), saved, hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DDL)
    return sorted((tuple(r) for r in trie.prefix_trie(*trie.with_lent_heads(trie.in_order(df))).collect()), key=str)


@pytest.mark.parametrize("turns", [1, 7, 100_000])
def test_equals_brute_force_whatever_the_blocks(spark, monkeypatch, turns):
    monkeypatch.setattr(trie, "BLOCK_TURNS", turns)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("ab" if c % 3 else ["é" * rng.randrange(4), "b"])) for c in range(95, 330) if c != 200 for t in range(rng.randrange(9))]
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(4)]  # many copies of one conversation
    assert made(spark, rows) == brute(rows)


def test_digests_of_runs_of_any_length(monkeypatch):
    """The workers' functions, called here: runs of a key over several batches give the digest of all its ids."""
    ids = {"a": list(range(-3, 20)), "b": [5], "c": list(range(100, 130))}
    rows = [(k, i) for k, v in ids.items() for i in v]
    for run in (1, 4, 8192):
        monkeypatch.setattr(trie, "RUN", run)
        for size in (1, 7, 100):
            batches = [pd.DataFrame(rows[i : i + size], columns=["key", "conv_id"]) for i in range(0, len(rows), size)] + [pd.DataFrame([], columns=["key", "conv_id"])]
            found = [tuple(r) for out in trie._digests(trie._runs(iter(batches))) for r in out.itertuples(index=False)]
            assert found == [(k, v[0], len(v), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for k, v in ids.items()]


def test_odd_rows(spark):
    rows = [
        (7, None, None, None), (7, 1, "user", ""), (7, 1, "user", ""), (7, 1, None, "x"),  # nulls, ties, repeated rows
        (None, 1, "user", "gone"), (-150, 2, "user", "minus"), (-100, 1, "user", "base"), (-100, 2, "user", "base"),
        (5000, 1, "user", "w" * 200_000), (5001, 1, "user", "w" * 200_000 + "!"), (5001, 2, "user", "ü世"),
    ]
    rows += [(6000, t, "user", f"turn {t % 7}") for t in range(200)]
    found = made(spark, rows)
    expected = brute([(None if r[0] is None else r[0], *r[1:]) for r in rows if r[0] is None or r[0] >= 0])
    low = [r for r in found if r[0] >= 0 and r[1] > 0]
    assert {r[:2] for r in low} >= {r[:2] for r in expected if r[1] > 0}
    assert sum(r[3] for r in found if r[1] == 0) == 6 and all(r[3] >= 1 for r in found)  # the root has all but the null id


def test_empty_table(spark):
    assert made(spark, []) == []
