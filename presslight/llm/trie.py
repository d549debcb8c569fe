"""Prefix trie of conversations by union-find over the edges between sorted neighbours.

Distinct turn sequences are sorted, and cut into blocks. Each pair of neighbours is an edge whose
depth is their longest common prefix (LCP). A block goes through its edges from the deepest to the shallowest
and joins what they connect by union-find: where components meet, a branching node arises, and
the depths between it and the next one above form a chain with the same members.

All that a node reports is a sum (or minimum) over its stretch of the sorted sequences, so a node whose stretch
runs over a block's boundary is contracted to its partial sums, under the digest of its prefix, and the
blocks' forests are merged by one aggregation of these. Only such open nodes, at most one per depth on
either side of a block, meet in a shuffle again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Turns of the sequences in one block, about, and ids that are joined to one piece of a digest's text.
BLOCK_TURNS, RUN = 100_000, 8192
#: Hex digits of a turn's digest within a path.
WIDTH = 32
EMPTY = hashlib.sha256(b"").hexdigest()


def in_order(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, position from 1, digest, chars.

    Turns stand in the order of turn (null first), role, text; null role and text count as empty, and a
    repeated row is a turn each time. Rows whose conv_id is null or no whole number take no part.
    Positions come from one sort of all rows, so a conversation of any length is dealt over many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = (
        turns.select(F.col("conv_id").try_cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
        .filter("conv_id IS NOT NULL")
        .withColumn("tie", F.monotonically_increasing_id())  # equal rows need not stay together
    )
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    laid = written(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(
            "conv_id",
            F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("digest"),
            F.char_length("text").cast("long").alias("chars"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "trie-turns",
    )
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = laid.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return laid.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("row") - F.col("first") + F.col("before") + 1).alias("position"), "digest", "chars")


def with_lent_heads(turns: DataFrame, span: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Ordered turns -> the turns with lent heads, and all conversations (conv_id).

    Conversation c takes the first h turns of conversation c - c % span (all if fewer, none if absent) and then its own
    after its first h; h = crc32 of c's decimal digits modulo `most`.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % span).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0))))
    heads = turns.filter((F.col("position") < most) & (F.col("conv_id") % span == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.select("conv_id", "base", "taken").join(heads, "base").filter("position <= taken").select("conv_id", "position", "digest", "chars")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("position > h").select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "digest", "chars")
    return own.unionByName(lent), convs.select("conv_id")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (key, conv_id) -> comma-joined runs of at most RUN ids of one key."""
    for pdf in batches:
        key, ids = pdf["key"].to_numpy(object), pdf["conv_id"].tolist()
        starts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
        parts = [(a, min(a + RUN, end)) for begin, end in zip(starts, starts[1:]) for a in range(begin, end, RUN)]
        rows = [(key[a], ids[a], b - a, ",".join(map(str, ids[a:b]))) for a, b in parts]
        yield pd.DataFrame(rows, columns=["key", "conv_id", "n_convs", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted runs -> one row a key with the digest of all its ids, read as a stream."""
    key, state, first, n = None, None, 0, 0
    for pdf in batches:
        done = []
        for k, conv_id, count, ids in zip(pdf["key"], pdf["conv_id"], pdf["n_convs"], pdf["ids"]):
            if k != key:
                if key is not None:
                    done.append((key, first, n, state.hexdigest()))
                key, state, first, n = k, hashlib.sha256(), conv_id, 0
            else:
                state.update(b",")
            state.update(ids.encode())
            n += count
        yield pd.DataFrame(done, columns=["key", "conv_id", "n_convs", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, first, n, state.hexdigest())], columns=["key", "conv_id", "n_convs", "ends"])


def _shared(a: str | None, b: str | None) -> int:
    """Turns at the start of two paths that agree; -1 if there is no second path."""
    if a is None or b is None:
        return -1
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def _joined(lengths: list[int], lcp: list[int], ids: list[int]) -> list[list[int]]:
    """Union-find over the edges lcp[i] between sequences i - 1 and i -> depth, first, last, smallest id, edges and parent of each node.

    Node i < n is the end of sequence i; a branching node follows where components meet above their top nodes. Edges of one depth go
    from left to right, so the component on the right always ends below that depth.
    """
    n = len(lengths)
    root, depth, first, last, least, edges, up = list(range(n)), list(lengths), list(range(n)), list(range(n)), list(ids), [0] * n, [-1] * n
    top = list(range(n))  # of the component of a root

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in sorted(range(1, n), key=lambda i: (-lcp[i], i)):
        a, b = find(i - 1), find(i)
        left, right = top[a], top[b]
        if depth[left] > lcp[i]:
            for column, x in ((depth, lcp[i]), (first, first[left]), (last, last[left]), (least, least[left]), (edges, 0), (up, -1)):
                column.append(x)
            up[left] = top[a] = left = len(depth) - 1
        up[right], last[left], least[left] = left, last[right], min(least[left], least[right])
        edges[left] += 1
        root[b] = a
    return [depth, first, last, least, edges, up]


FOREST = "block int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, key string, up_conv long, up_key string"


def _forest(paths: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one block; open ones have a key, and those under an open one its key as up_key."""
    paths = paths.sort_values("path", kind="stable", ignore_index=True)
    path, chars = paths["path"].tolist(), paths["chars"].tolist()
    n, lengths = len(path), [len(p) // WIDTH for p in path]
    edge = edges.iloc[0]
    around = [edge["before"] if isinstance(edge["before"], str) else None, *path, edge["after"] if isinstance(edge["after"], str) else None]
    lcp = [_shared(a, b) for a, b in zip(around, around[1:])]  # lcp[i]: with the sequence before i; lcp[n]: of the last with the next block
    cum = [np.cumsum(c, dtype=np.int64) for c in chars]  # by depth; the root's is 0
    weight, ids = paths["n_convs"].to_numpy(np.int64), paths["conv_id"].to_numpy(np.int64)
    total = np.array([c[-1] for c in cum], dtype=np.int64)
    new = np.array([t - (c[k] if k >= 0 else 0) for t, c, k in zip(total, cum, lcp)], dtype=np.int64)  # code points of nodes that no sequence before has
    run = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    weights, masses, news = run(weight), run(weight * total), run(new)
    leaves = run([int(lcp[i + 1] < lengths[i]) for i in range(n)])

    depth, lo, hi, least, edges_at, up = (np.array(x, dtype=np.int64) for x in _joined(lengths, lcp[:n], ids.tolist()))
    up_depth = np.where(up >= 0, depth[up], -1)
    counts = depth - up_depth  # depths of a chain
    at = np.repeat(np.arange(len(depth)), counts)
    e = np.concatenate([np.arange(u + 1, d + 1) for d, u in zip(depth.tolist(), up_depth.tolist())])
    a, b, bottom = lo[at], hi[at], depth[at] == e
    offset = np.concatenate(([0], np.cumsum([len(c) for c in cum])))
    flat = np.concatenate(cum)
    before = np.where(e > 0, flat[offset[a] + np.maximum(e - 1, 0)], 0)
    goes_on = (a == 0) & (lcp[0] >= e)  # from the block before
    open_ = goes_on | ((b == n - 1) & (lcp[n] >= e))
    length = np.array(lengths, dtype=np.int64)
    first_child = np.where(goes_on, lcp[0] == e, length[a] > e).astype(np.int64)
    distinct = np.where(goes_on, new[a], total[a] - before) + news[b + 1] - news[a + 1]
    ends = paths["ends"].to_numpy(object)
    ended = np.where(~goes_on & (length[a] == e), ends[a], None)

    def key(i: int, d: int) -> str:
        return hashlib.md5(path[i][: d * WIDTH].encode()).hexdigest()

    top = e == up_depth[at] + 1  # the uppermost depth of a chain: its parent is the node above
    above = np.where(top, up[at], at)
    up_a, up_b, parent = lo[above], hi[above], least[above]
    up_open = (e > 0) & (((up_a == 0) & (lcp[0] >= e - 1)) | ((up_b == n - 1) & (lcp[n] >= e - 1)))
    return pd.DataFrame({
        "block": int(edge["block"]), "depth": e, "conv_id": least[at], "n_convs": weights[b + 1] - weights[a],
        "n_children": first_child + np.where(bottom, edges_at[at], 0), "n_leaves": leaves[b + 1] - leaves[a],
        "saved": masses[b + 1] - masses[a] - (weights[b + 1] - weights[a]) * before - distinct, "ends": ended,
        "key": [key(i, d) if o else None for i, d, o in zip(a.tolist(), e.tolist(), open_.tolist())],
        "up_conv": pd.array([p if d > 0 and not o else None for p, d, o in zip(parent.tolist(), e.tolist(), up_open.tolist())], dtype="Int64"),
        "up_key": [key(i, d - 1) if o else None for i, d, o in zip(a.tolist(), e.tolist(), up_open.tolist())],
    })


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns(conv_id, position, digest, chars) with positions from 1 and all convs(conv_id) -> the nodes of their trie.

    A node is a distinct sequence of first `depth` turns; its members are the conversations that begin with it. Returns
    conv_id (its smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (over its subtree,
    (n_convs - 1) times the code points of each node's last text) and ends_sha256 (of the ids that end there). Conversations without
    turns are members of the root; no conversation gives no node. A sequence's digests, 40 bytes a turn, must fit into one row.
    """
    sequences = turns.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("position"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("chars")))
    laid = sequences.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "digest", "chars"))).alias("t"))
    laid = laid.select("conv_id", F.array_join(F.transform("t", lambda x: x["digest"]), "").alias("path"), F.transform("t", lambda x: x["chars"]).alias("chars"))
    laid = written(laid.withColumn("key", F.md5(F.col("path").cast("binary"))), "trie-sequences")

    runs = laid.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInPandas(_runs, "key string, conv_id long, n_convs long, ids string")
    ends = runs.repartition("key").sortWithinPartitions("key", "conv_id").mapInPandas(_digests, "key string, conv_id long, n_convs long, ends string")
    shapes = laid.groupBy("key").agg(F.first("path").alias("path"), F.first("chars").alias("chars"))
    n_turns = laid.agg(F.sum(F.size("chars"))).first()[0] or 0
    blocks = shapes.join(ends, "key").drop("key").repartitionByRange(max(1, -(-n_turns // BLOCK_TURNS)), "path").withColumn("block", F.spark_partition_id())
    blocks = written(blocks, "trie-blocks")

    by_block = W.orderBy("block")  # a row a block
    edges = blocks.groupBy("block").agg(F.min("path").alias("least"), F.max("path").alias("most"))
    edges = edges.select("block", F.lag("most").over(by_block).alias("before"), F.lead("least").over(by_block).alias("after"))
    forest = written(blocks.groupBy("block").cogroup(edges.groupBy("block")).applyInPandas(_forest, FOREST), "trie-forest")

    sums = ("n_convs", "n_children", "n_leaves", "saved")
    merged = forest.filter("key IS NOT NULL").groupBy("key").agg(F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums), F.max("ends").alias("ends"), F.max("up_key").alias("up_key"))
    named = merged.select(F.col("key").alias("up_key"), F.col("conv_id").alias("up_open"))
    within = forest.filter("key IS NOT NULL").select("block", F.col("key").alias("up_key")).distinct().join(named, "up_key")  # so that many children of one open node meet it block by block
    closed = forest.filter("key IS NULL").join(within, ["block", "up_key"], "left").withColumn("up_conv", F.coalesce("up_conv", "up_open"))
    opened = merged.join(named, "up_key", "left").withColumnRenamed("up_open", "up_conv")
    columns = ["conv_id", "depth", "up_conv", *sums, "ends"]
    nodes = closed.select(*columns).unionByName(opened.select(*columns))
    return nodes.select("conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_lent_heads(in_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: Every prefix of every conversation as a string of its turns' digests; crc32 is done bit by bit.
SQL = """
WITH s AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS position
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT],
                                      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 6 AS h
      FROM s GROUP BY conv_id),
b AS (SELECT c.conv_id, c.conv_id - c.conv_id % 100 AS base, c.h, least(c.h, coalesce(o.n, 0)) AS taken FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 100),
r AS (SELECT conv_id, position - h + taken AS depth, role, text FROM s JOIN b USING (conv_id) WHERE position > h
      UNION ALL SELECT b.conv_id, s.position, s.role, s.text FROM b JOIN s ON s.conv_id = b.base WHERE s.position <= taken),
p AS (SELECT conv_id, depth, length(text) AS chars, string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM l GROUP BY path, depth),
k AS (SELECT path[:(depth - 1) * 32] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT p.path, sum((m.n_children = 0)::BIGINT) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved_tokens
      FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.path)
SELECT m.conv_id, m.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN u USING (path) LEFT JOIN m o ON m.depth > 0 AND o.path = m.path[:(m.depth - 1) * 32]
"""
