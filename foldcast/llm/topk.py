"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into segments. Per segment the mean and deviation of a vector bound its
distance to any other from below: ``|x - q|^2 >= sum of w * ((mx - mq)^2 + (sx - sq)^2)``, so
with the norms known they bound the inner product from above. Blocks of queries meet blocks
of candidates; the bounds are taken with few segments, then with more, and only pairs that
may still reach a query's k-th best exact score are computed exactly.

Blocks have a constant number of rows. A block pair is one group of a shuffle, so neither the
queries nor the candidates ever meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast.llm.common import table

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 16_384, 8_192
#: Pairs that are looked at together, and the numbers of segments, coarse to fine.
TILE, LEVELS = 1 << 20, (4, 16)
#: The share of a tile's pairs above which the next step takes the whole tile in one product.
DENSE = 0.01


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row: sqrt(w) * mean and sqrt(w) * deviation of each segment, end to end."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    w = np.sqrt([p.shape[1] for p in parts])
    return np.hstack([np.stack([p.mean(1) for p in parts], 1) * w, np.stack([p.std(1) for p in parts], 1) * w])


def block_top(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best in a block, ties to smaller ids.

    Arrays are int64 (rows x dimensions); a query doesn't meet its own id.
    """
    order = np.argsort(x_id, kind="stable")
    x, x_id = x[order], x_id[order]
    exact_float = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**52
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    levels = [(segment_statistics(qf, s), segment_statistics(xf, s)) for s in LEVELS if s < q.shape[1]]
    slack = 1e-6 * (1 + np.sqrt((qf**2).sum(1)).max(initial=0) * np.sqrt((xf**2).sum(1)).max(initial=0))
    rows, cols, scores = [], [], []
    step = max(1, TILE // max(1, len(x)))
    for at in range(0, len(q), step):
        own = slice(at, at + step)
        bound = levels[0][0][own] @ levels[0][1].T if levels else np.full((len(q[own]), len(x)), np.inf)
        same = q_id[own][:, None] == x_id[None, :]
        bound[same] = -np.inf
        # a first threshold: the k-th best exact score among those with the best bounds
        m = min(2 * k, len(x))
        first = np.argpartition(-bound, m - 1, axis=1)[:, :m]
        got = np.einsum("qd,qmd->qm", qf[own], xf[first])
        got[np.take_along_axis(same, first, 1)] = -np.inf
        kth = -np.partition(-got, min(k, m) - 1, axis=1)[:, min(k, m) - 1] if m >= k else np.full(len(got), -np.inf)
        need = (kth - slack)[:, None]
        alive = (bound >= need) & ~same
        for sq, sx in levels[1:]:
            if alive.mean() > DENSE:
                alive &= sq[own] @ sx.T >= need
        if alive.mean() > DENSE and exact_float:
            score = qf[own] @ xf.T
            r, c = np.nonzero(alive & (score >= kth[:, None]))
            s = score[r, c].astype(np.int64)
        else:
            r, c = np.nonzero(alive)
            s = np.concatenate([_exact(q[own], x, r[i : i + TILE], c[i : i + TILE], exact_float) for i in range(0, len(r), TILE)] or [np.zeros(0, np.int64)])
        best = np.lexsort((c, -s, r))
        r, c, s = r[best], c[best], s[best]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(r[place < k] + at)
        cols.append(order[c[place < k]])
        scores.append(s[place < k])
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, cols, scores))


def _exact(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray, exact_float: bool) -> np.ndarray:
    if exact_float:
        return np.einsum("nd,nd->n", q[r].astype(np.float64), x[c].astype(np.float64)).astype(np.int64)
    return (q[r] * x[c]).sum(1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of ``vectors`` for each row of ``queries`` by inner product.

    Both have vec_id long and v array<long>, without nulls. Vectors of another length than a
    query's don't meet it. Fewer than k others: all of them. Rows that repeat a query's
    vec_id are its own and are left out as candidates; of several query rows with one vec_id the one with the
    smallest vector counts, by length, then by components in turn. A vec_id that several candidate rows share
    is ranked once for each. Returns (query_id, rank int, vec_id, score long).
    """
    n_x, n_q = vectors.count(), queries.count()
    xb, qb = max(1, -(-n_x // CANDIDATES)), max(1, -(-n_q // QUERIES))
    size = F.size("v")
    x = vectors.select("vec_id", "v", size.alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(xb)).alias("xb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"), F.lit(False).alias("ask"))
    q = queries.groupBy("vec_id").agg(F.min(F.struct(F.size("v"), "v"))["v"].alias("v")).select("vec_id", "v", size.alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(xb - 1).cast("long"))).alias("xb"), F.pmod(F.xxhash64("vec_id"), F.lit(qb)).cast("int").alias("qb"), F.lit(True).alias("ask"))

    def search(t: pa.Table) -> pa.Table:
        ask, ids = t.column("ask").to_numpy(), t.column("vec_id").to_numpy()
        d = t.column("d")[0].as_py() if len(t) else 0
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
        r, c, s = block_top(v[ask], ids[ask], v[~ask], ids[~ask], k) if ask.any() and (~ask).any() and d else ([], [], [])
        return pa.table({"query_id": pa.array(ids[ask][r] if len(r) else [], pa.int64()), "vec_id": pa.array(ids[~ask][c] if len(c) else [], pa.int64()), "score": pa.array(s, pa.int64())})

    near = x.unionByName(q).groupBy("xb", "qb", "d").applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); null, empty or non-finite vectors are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.where("vec_id is not null").where(F.coalesce(fine, F.lit(False)) & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the 20 best of all vectors for each one whose id is divisible by 20."""
    v = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.where("vec_id % 20 = 0"), 20)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20
"""
