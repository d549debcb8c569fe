"""Exact top-k search by inner product as a Voronoi kNN join.

Rows are grouped by their nearest pivot. A group's summary (rows, largest distance to the pivot,
largest norm) bounds the inner product of any query with any of its rows:
q.p - |q| r <= q.x <= min(q.p + |q| r, |q| max|x|). A query's k-th best score is at least what the
groups' lower bounds guarantee, and at least its k-th best score in the sample the pivots come from.
It goes only to groups whose upper bound reaches that; each group is solved locally and the best k
of all answers remain. Groups are cut into blocks of bounded size, queries into packs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, written

#: Rows from which pivots (and a first bound) are taken, chosen by a hash of the id: fixed, whatever the table's size.
SAMPLE = 4096
#: Rows of a data block and queries of a pack, about.
BLOCK, PACK = 4096, 1024
PIVOTS_LEAST, PIVOTS_MOST = 8, 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v = floor(scale * x) of each component as long; rows without id, null or with non-finite parts take no part.

    Each row stays, also one that repeats another in id or in full. The range of long bounds a component.
    """
    x = F.col(vec_col)
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & sound).select(F.col(id_col).alias("vec_id"), whole.alias("v"))


def _matrix(rows, width: int) -> np.ndarray:
    """Rows as one int64 matrix; shorter vectors end in zeros."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly: in doubles where these hold the integers, else in Python's integers, held to the range of long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    largest = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if largest < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _pivots(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """A few rounds of k-means on the sample, from its first rows."""
    points = sample.astype(np.float64)
    centres = np.unique(points, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(n, len(centres))).astype(int)]
    for _ in range(rounds):
        near = _nearest(points, centres)[0]
        centres = np.stack([points[near == g].mean(axis=0) if (near == g).any() else centres[g] for g in range(len(centres))])
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None]
    near = apart.argmin(axis=1)
    return near, np.linalg.norm(points - centres[near], axis=1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """vectors(vec_id, v) -> query_id, rank, vec_id, score: each query's k rows of the largest inner product.

    Queries are the rows for which is_query holds; candidates all rows but the query's own, whatever their ids: rows are told apart by
    a number that each gets here, so a repeated row is a candidate as often as it stands, and two queries of one id have
    a ranking each. Ties go to the smaller vec_id. Fewer candidates than k give fewer rows, an empty table none.
    Vectors of unequal length compare as if zeros followed the shorter one.
    """
    spark = vectors.sparkSession
    vectors = written(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")  # the numbers hold, and it is read several times below
    width, rows = vectors.agg(F.max(F.size("v")), F.count("*")).first()
    width = width or 0
    sample = vectors.withColumn("_h", F.xxhash64("vec_id", "row")).orderBy("_h", "row").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sampled, points = np.array([r["row"] for r in sample], dtype=np.int64), _matrix([r["v"] for r in sample], width)
    centres = _pivots(points, int(min(PIVOTS_MOST, max(PIVOTS_LEAST, rows // BLOCK))))

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = _matrix(pdf["v"].tolist(), width).astype(np.float64)
            near, radius = _nearest(m, centres)
            yield pdf.assign(grp=near.astype("int32"), radius=radius, norm=np.linalg.norm(m, axis=1))

    data = vectors.mapInPandas(grouped, "vec_id long, v array<long>, row long, grp int, radius double, norm double")
    summary = data.groupBy("grp").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).orderBy("grp").toPandas()
    alive = summary["grp"].to_numpy()
    counts, radii, norms, middle = summary["n"].to_numpy(), summary["radius"].to_numpy(), summary["norm"].to_numpy(), centres[alive]

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each query and group that it needs."""
        for pdf in batches:
            if not len(pdf):
                continue
            q = _matrix(pdf["v"].tolist(), width)
            size, at = np.linalg.norm(q.astype(np.float64), axis=1)[:, None], q.astype(np.float64) @ middle.T
            slack = 1e-9 * (1 + np.abs(at) + size * (radii + norms))  # of rounding
            low, high = at - size * radii - slack, np.minimum(at + size * radii, size * norms) + slack
            order = np.argsort(-low, axis=1)
            sure = np.cumsum(counts[order], axis=1) >= k + 1  # one may be the query itself
            floor_ = np.where(sure.any(axis=1), np.take_along_axis(low, order, axis=1)[np.arange(len(q)), sure.argmax(axis=1)], -np.inf)
            if len(sampled) > k:
                seen = _products(q, points).astype(np.float64)
                seen[pdf["row"].to_numpy()[:, None] == sampled[None]] = -np.inf
                floor_ = np.maximum(floor_, np.partition(seen, -k, axis=1)[:, -k])
            i, g = np.nonzero(high >= floor_[:, None])
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[i], "row": pdf["row"].to_numpy()[i], "v": [pdf["v"].iloc[x] for x in i], "grp": alive[g].astype("int32")})

    queries = vectors.filter(is_query)
    packs = max(1, -(-queries.count() // PACK))
    blocks = F.create_map(*(F.lit(int(x)) for g, n in zip(alive, counts) for x in (g, -(-int(n) // BLOCK))))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"], kind="stable")
        return pd.DataFrame({
            "grp": pdf["grp"].iloc[:1], "part": pdf["part"].iloc[:1], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
            "own": [pdf["row"].to_numpy(np.int64).tobytes()], "m": [_matrix(pdf["v"].tolist(), width).tobytes()],
        })

    pack = "grp int, part long, ids binary, own binary, m binary"
    held = data.withColumn("part", F.pmod(F.xxhash64("row"), blocks[F.col("grp")].cast("long"))).groupBy("grp", "part").applyInPandas(packed, pack)
    asked = (
        queries.mapInPandas(sent, "vec_id long, row long, v array<long>, grp int")
        .withColumn("part", F.pmod(F.xxhash64("row"), F.lit(packs)))
        .groupBy("grp", "part")
        .applyInPandas(packed, pack)
    )

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q_ids, q_own, q_m, d_ids, d_own, d_m in zip(*(pdf[c] for c in ("q_ids", "q_own", "q_m", "ids", "own", "m"))):
                qi, q_rows, di, d_rows = (np.frombuffer(x, np.int64) for x in (q_ids, q_own, d_ids, d_own))
                scores = _products(np.frombuffer(q_m, np.int64).reshape(len(qi), width), np.frombuffer(d_m, np.int64).reshape(len(di), width))
                best = []
                for i, row, s in zip(qi, q_rows, scores):
                    at = np.flatnonzero(d_rows != row)
                    if len(at) > k:
                        s_ = s[at]
                        at = at[s_ >= np.partition(s_, -k)[-k]]
                    at = at[np.argsort(-s[at], kind="stable")[:k]]  # di ascends, so ties go to the smaller id
                    best.append((np.full(len(at), i), np.full(len(at), row), di[at], d_rows[at], s[at]))
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(names, zip(*best))} if best else {c: [] for c in names})

    small_batches(spark)
    names = ["query_id", "query_row", "vec_id", "row", "score"]
    pairs = asked.select("grp", F.col("ids").alias("q_ids"), F.col("own").alias("q_own"), F.col("m").alias("q_m")).join(held.select("grp", "ids", "own", "m"), "grp")
    best = pairs.mapInPandas(solved, ", ".join(f"{c} long" for c in names))
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, F.col("vec_id") % 20 == 0, 20)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n AS q, c.n AS c, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON c.n <> q.n WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
