"""Operators over score tables and vector tables.

Score tables are long: ``(group..., token_id, score)``.  Group statistics are
partial aggregates joined back on the group key; the aggregate that follows a
join first folds salted parts of a group, so a hot group is spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import PAD_ID
from tessera.functions.arrays import scale_vector

# Parts that a group is cut into before its scores are summed.
SALTS = 16


def log_softmax(df: DataFrame, by: list[str], score: str = "score", out: str = "log_prob",
                small_groups: bool = False) -> DataFrame:
    """``score - (max + log(sum(exp(score - max))))`` within each group.

    Default: each task folds its rows of a salted part of a group to (max,
    exp-sum), the parts are folded to one row a group, and that is joined back
    on ``by``; both sides of the join are plain shuffles, so AQE can split a
    huge group there as well.  ``small_groups=True`` uses one window
    partitioned by ``by`` (one shuffle) for groups known to be small, such as
    one position's scores over a vocabulary.
    """
    if small_groups:
        from pyspark.sql import Window

        w = Window.partitionBy(*by)
        m = F.max(score).over(w)
        shifted = df.withColumn("_s", F.col(score) - m)
        lse = F.log(F.sum(F.exp("_s")).over(w))
        return shifted.withColumn(out, F.col("_s") - lse).drop("_s")
    salted = df.select(*by, score, F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).alias("_salt"))
    most = salted.groupBy(*by, "_salt").agg(F.max(score).alias("_m"))
    parts = salted.join(most, [*by, "_salt"]).groupBy(*by, "_salt", "_m").agg(F.sum(F.exp(F.col(score) - F.col("_m"))).alias("_s"))
    top = parts.groupBy(*by).agg(F.max("_m").alias("_mm"), F.collect_list(F.struct("_m", "_s")).alias("_parts"))  # SALTS entries
    total = F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["_s"] * F.exp(p["_m"] - F.col("_mm")))
    lse = top.select(*by, (F.col("_mm") + F.log(total)).alias("_lse"))
    return df.join(lse, by).withColumn(out, F.col(score) - F.col("_lse")).drop("_lse")


def argmax(df: DataFrame, by: list[str], score: str = "score", token: str = "token_id") -> DataFrame:
    """The best candidate per group; on a tie the lowest token id wins."""
    best = F.max_by(F.struct(F.col(token).alias("t"), F.col(score).alias("s")), F.struct(F.col(score), -F.col(token)))
    return df.groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.t").alias(token), F.col("_b.s").alias(score)
    )


def smoothed_nll(log_probs: DataFrame, labels: DataFrame, by: list[str], label: str = "label",
                 token: str = "token_id", log_prob: str = "log_prob", pad: int = PAD_ID,
                 eps: float = 0.1) -> DataFrame:
    """Label-smoothed cross entropy ignoring PAD targets, mean over kept
    positions: ``(1-eps) * nll(label) + eps/V * sum_v nll(v)``.

    ``log_probs`` holds one row per (position, candidate); ``labels`` one row
    per position.  One aggregate per position, one global average.
    """
    lp = log_probs.join(labels.where(F.col(label) != F.lit(pad)), by)
    per_pos = lp.groupBy(*by).agg(
        F.sum(F.when(F.col(token) == F.col(label), -F.col(log_prob))).alias("_nll"),
        F.sum(-F.col(log_prob)).alias("_all"),
        F.count(F.lit(1)).alias("_v"),
    )
    loss = (F.lit(1.0 - eps) * F.col("_nll")) + F.lit(eps) * F.col("_all") / F.col("_v")
    return per_pos.agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).cast("bigint").alias("n_positions"))


def embed(ids: DataFrame, vectors: DataFrame, key: str, ids_col: str = "ids", id_col: str = "vec_id",
          vec_col: str = "embedding", dim: int | None = None, missing: str = "error") -> DataFrame:
    """Look every id up in a vector table and scale by ``sqrt(d)``.

    Output: one row per (row, position).  Spark picks the join from the
    measured size of the vector table.  An id that the table lacks fails the
    job; ``missing="null"`` keeps its row with a NULL vector instead.
    """
    toks = ids.select(F.col(key), F.posexplode(ids_col).alias("pos", "_tok"))
    v = vectors.select(F.col(id_col).alias("_tok"), F.col(vec_col).alias("_vec"))
    j = toks.join(v.withColumn("_known", F.lit(True)), "_tok", "left")
    if missing == "error":
        absent = F.raise_error(F.concat(F.lit("no vector for id "), F.coalesce(F.col("_tok").cast("string"), F.lit("NULL"))))
        j = j.withColumn("_tok", F.when(F.col("_known"), F.col("_tok")).otherwise(absent.cast("bigint")))
    factor = F.lit(math.sqrt(dim)) if dim else F.sqrt(F.size("_vec").cast("double"))
    return j.select(key, "pos", F.col("_tok").alias("token_id"), scale_vector("_vec", factor).alias("vector"))
