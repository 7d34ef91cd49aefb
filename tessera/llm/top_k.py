"""Exact top-k search by tiled integer matrix products.

Queries and candidates are dealt to blocks, and every pair of a query block
and a candidate block is a tile: one task step multiplies the two, keeps the k
best of each query, and passes only those on.  The lists of a query are then
merged in a tree, so no task gets more than ``FAN`` lists of a query at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1024
FAN = 32
K = 20
SCALE = 64


def usable(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def _products(qs: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; those beyond 64 bits are an error."""
    bound = np.abs(cand).max() * np.abs(qs).max() * cand.shape[1]
    if bound < 2.0 ** 53:  # every partial sum is an exact double
        return (qs @ cand.T).astype(np.int64)
    if bound < 2.0 ** 62:
        return qs.astype(np.int64) @ cand.astype(np.int64).T
    # a few very large components: Python's integers for the whole tile, which is slow but exact
    scores = np.array([[int(v) for v in row] for row in qs], object) @ np.array([[int(v) for v in row] for row in cand], object).T
    if max(abs(int(v)) for v in scores.ravel()) >= 1 << 63:
        raise ValueError("an inner product does not fit 64 bits")
    return scores.astype(np.int64)


def _best(scores: np.ndarray, m: int) -> np.ndarray:
    """Places of the m largest scores of each row, the first places of equal ones, in that order.

    A partial selection; a row is sorted whole only where the m-th score is tied beyond the part picked.
    """
    if m >= scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")
    part = np.sort(np.argpartition(-scores, m - 1, axis=1)[:, :m], axis=1)
    values = np.take_along_axis(scores, part, axis=1)
    best = np.take_along_axis(part, np.argsort(-values, axis=1, kind="stable"), axis=1)
    tied = np.flatnonzero((scores >= values.min(axis=1, keepdims=True)).sum(axis=1) > m)
    if len(tied):
        best[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :m]
    return best


def _tile(k: int):
    def run(table: pa.Table) -> pa.Table:
        query = np.asarray(table.column("is_query"))
        ids = np.asarray(table.column("vec_id")).astype(np.int64)
        x = np.asarray(table.column("vector").combine_chunks().flatten()).astype(np.float64).reshape(len(ids), -1)
        block = np.asarray(table.column("c"))[0]
        order = np.argsort(ids[~query], kind="stable")
        cand, cand_ids = x[~query][order], ids[~query][order]
        qs, q_ids = x[query], ids[query]
        out = []
        if len(cand) and len(qs):
            scores = _products(qs, cand)
            own = q_ids[:, None] == cand_ids[None, :]
            best = _best(scores, min(k + int(own.sum(axis=1).max()), len(cand)))
            for i in range(len(qs)):
                pick = best[i][~own[i, best[i]]][:k]
                out.append((np.full(len(pick), q_ids[i]), cand_ids[pick], scores[i, pick]))
        cols = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2],
                         "c": np.full(len(cols[0]), block, np.int64)})

    return run


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          scale: int = SCALE, tile: int = TILE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each query row.

    Components become floor(scale * x) with x as double; the score is the
    integer inner product, ties go to the smaller id.  A row is not its own
    candidate.  Null ids, null vectors, and vectors that are empty or hold null
    or non-finite components take no part; vectors are compared with those of
    their own length.  A score that does not fit 64 bits is an error.  An empty table
    gives an empty one; other columns are ignored.  Rows that repeat an id count once (the smallest vector).
    ``is_query`` is a condition on the column ``vec_id``.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = rows.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector"),
                       F.size("vector").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_blocks, q_blocks = max(1, math.ceil(n / tile)), max(1, math.ceil(n_queries / tile))

    def block(salt: str, number: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(number))

    def each(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long")))

    keep = ["vec_id", "vector", "dim"]
    candidates = rows.select(*keep, F.lit(False).alias("is_query"), block("c", n_blocks).alias("c"), each(q_blocks).alias("q"))
    queries = rows.where("asks").select(*keep, F.lit(True).alias("is_query"), each(n_blocks).alias("c"), block("q", q_blocks).alias("q"))
    lists = candidates.unionByName(queries).groupBy("q", "c", "dim").applyInArrow(
        _tile(k), "query_id long, vec_id long, score long, c long")
    groups = n_blocks
    while True:
        groups = math.ceil(groups / FAN)
        by = ["query_id"] + (["c"] if groups > 1 else [])
        best = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
        lists = lists.withColumn("c", F.floor(F.col("c") / FAN)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if groups == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
