"""Exact ranks, splits, per-epoch shuffles, batches and steps.

The base is :func:`exact_rank`.  Rows are cut into *buckets* by an
order-preserving, deterministic coarsening of the order (a prefix of the
md5 order key, or a range of batch ids), ranked with ``row_number`` inside
their bucket, and shifted by a table of bucket offsets.  The offset table has
one row per bucket; how it is joined is left to Spark.

Nothing depends on sampling, partition ids or arrival order: a retried task
or a re-evaluated branch gets the same ranks.  No window ever runs over the
data without a partition key, and hash-prefix buckets are uniform, so no
bucket is hot even when one group holds a third of all rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def hash_key(key, seed: str) -> Column:
    """Seeded order key: ``md5(key || ':' || seed)`` (hex text, compared as bytes)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.coalesce(k.cast("string"), F.lit("")), F.lit(":"), F.lit(str(seed))))


def _parts(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def hex_digits_for(df: DataFrame, num_partitions: int | None = None) -> int:
    """Hash-prefix length giving at least 4 buckets per shuffle partition (2
    hex digits at least).  There is no upper limit: partitions grow with the
    data, and so do the buckets; ranks do not depend on their number."""
    n = max(_parts(df, num_partitions) * 4, 16)
    return max(2, math.ceil(math.log(n, 16)))


def exact_rank(df: DataFrame, order_cols: list, bucket_cols: list, rank_col: str = "rank",
               group_cols: list | None = None, total_col: str | None = None,
               broadcast_offsets: bool = False) -> DataFrame:
    """Exact 0-based rank in the order of ``order_cols`` (unique, total),
    inside each ``group_cols`` group when given.

    ``bucket_cols`` must be deterministic and non-decreasing in the order
    (e.g. a prefix of the order key).  ``total_col`` adds the row count of the
    row's group, read from the same offset table.  The join with the offsets
    is left to Spark, which broadcasts them only when their measured size is
    small; ``broadcast_offsets`` asks for it where a caller knows the bound.
    NULL keys, groups and buckets are values like any other.
    """
    gnames = list(group_cols or [])
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    bks = [(f"_bk{i}", F.col(c) if isinstance(c, str) else c) for i, c in enumerate(bucket_cols)]
    d = df
    for name, c in bks:
        d = d.withColumn(name, c)
    bnames = [n for n, _ in bks]
    part = [*(F.col(g) for g in gnames), *(F.col(b) for b in bnames)]
    local = d.withColumn("_loc", F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)
    # counted from the windowed rows, so both branches share one shuffle
    counts = local.groupBy(*gnames, *bnames).agg(F.count(F.lit(1)).alias("_n"))
    gw = Window.partitionBy(*(F.col(g) for g in gnames)) if gnames else Window.partitionBy(F.lit(0))
    before = gw.orderBy(*bnames).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *gnames, *bnames,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(gw).alias("_tot"),
    )
    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in [*gnames, *bnames]], "_off", "_tot")
    offsets = F.broadcast(offsets) if broadcast_offsets else offsets
    same = F.lit(True)
    for c in [*gnames, *bnames]:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    out = local.join(offsets, same).drop(*[f"_o_{c}" for c in [*gnames, *bnames]])
    out = out.withColumn(rank_col, F.col("_off") + F.col("_loc"))
    if total_col:
        out = out.withColumn(total_col, F.col("_tot"))
    return out.drop("_loc", "_off", "_tot", *bnames)


def rank_by_hash(df: DataFrame, key: str, seed: str, rank_col: str, group_cols: list | None = None,
                 total_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Exact rank in ``(md5(key:seed), key)`` order, bucketed by a hash prefix."""
    digits = hex_digits_for(df, num_partitions)
    d = df.withColumn("_h", hash_key(key, seed))
    return exact_rank(d, ["_h", key], [F.substring("_h", 1, digits)], rank_col=rank_col,
                      group_cols=group_cols, total_col=total_col).drop("_h")


def rank_within(df: DataFrame, group_cols: list[str], key: str, seed: str, rank_col: str = "rank",
                size_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Exact 0-based hash-order rank inside each group."""
    return rank_by_hash(df, key, seed, rank_col, group_cols=group_cols, total_col=size_col,
                        num_partitions=num_partitions)


def split_pairs(df: DataFrame, key: str = "pair_id", seed: str = "42", ratio: float = 0.9,
                rank_col: str = "split_rank", num_partitions: int | None = None) -> DataFrame:
    """Exact-size split: the first ``int(ratio*n)`` rows in hash order are
    ``train``, the rest ``validation``; disjoint and complete."""
    r = rank_by_hash(df, key, seed, rank_col, total_col="_n", num_partitions=num_partitions)
    train_n = F.floor(F.lit(float(ratio)) * F.col("_n").cast("double"))
    return r.withColumn("split", F.when(F.col(rank_col) < train_n, F.lit("train")).otherwise(F.lit("validation"))).drop(
        "_n"
    )


def shuffle(df: DataFrame, key: str = "pair_id", seed: str = "42", epoch: int = 0, by: list[str] | None = None,
            rank_col: str = "order", num_partitions: int | None = None) -> DataFrame:
    """Per-epoch order: rank by ``md5(key:seed:epoch)`` (inside ``by`` groups)."""
    return rank_by_hash(df, key, f"{seed}:{epoch}", rank_col, group_cols=by, num_partitions=num_partitions)


def epoch_orders(df: DataFrame, epochs: list[int], key: str = "pair_id", seed: str = "42",
                 by: list[str] | None = None, rank_col: str = "order",
                 num_partitions: int | None = None) -> DataFrame:
    """D2 for several epochs in one job: one row per (row, epoch)."""
    by = list(by or [])
    d = df.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    digits = hex_digits_for(df, num_partitions)
    d = d.withColumn("_h", F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}:"), F.col("epoch").cast("string"))))
    return exact_rank(d, ["_h", key], [F.substring("_h", 1, digits)], rank_col=rank_col,
                      group_cols=["epoch", *by]).drop("_h")


#: Rounds of the permutation's network.
ROUNDS = 6
#: Modulus of the round function: squares of smaller numbers fit 64 bits.
MODULUS = (1 << 31) - 1


def round_keys(seed: str, epoch: int) -> list[int]:
    """Keys of the rounds, from ``md5(seed:epoch:round)``."""
    return [int(hashlib.md5(f"{seed}:{epoch}:{i}".encode()).hexdigest()[:7], 16) for i in range(ROUNDS)]


def permute(rank: np.ndarray, n: np.ndarray, keys: list[int]) -> np.ndarray:
    """The place of each ``rank`` in the keyed permutation of its ``[0, n)``.

    ``[0, side**2)`` with ``side = ceil(sqrt(n))`` is permuted by a Feistel network: a number is
    (left, right) in base ``side``, and each round gives (right, left + f(right, key) mod ``side``)
    with ``f`` two squarings modulo ``MODULUS``.  A result outside ``[0, n)`` is permuted again
    until it is inside (cycle walking), which makes it a permutation of ``[0, n)``; that
    is rare, as at most about ``2 / sqrt(n)`` of the numbers are outside.
    """
    x, side = rank.astype(np.int64), np.ceil(np.sqrt(n)).astype(np.int64)
    todo = np.arange(len(x))
    while len(todo):
        y, s = x[todo], side[todo]
        for key in keys:
            left, right = np.divmod(y, s)
            f = (right + key) % MODULUS
            f = (f * f % MODULUS + key) % MODULUS
            y = right * s + (left + f * f % MODULUS) % s
        x[todo] = y
        todo = todo[y >= n[todo]]
    return x


def permuted(rank: Column, n: Column, seed: str, epochs: list[int]) -> Column:
    """Places of ``rank`` in the orders of the epochs, as an array: no sort and no shuffle.

    An Arrow function: the rounds are a few numpy steps a batch, which lambdas over arrays in the JVM
    are far from (measured: 19 s against 1 s for 166,880 places).
    """
    keys = [round_keys(seed, e) for e in epochs]

    @F.arrow_udf(ArrayType(LongType()))
    def places(rank: pa.Array, n: pa.Array) -> pa.Array:
        r, size = np.asarray(rank).astype(np.int64), np.asarray(n).astype(np.int64)
        flat = np.column_stack([permute(r, size, k) for k in keys]) if len(r) else np.zeros((0, len(keys)), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * len(keys), pa.int32()), pa.array(flat.ravel(), pa.int64()))

    return places(rank.cast("bigint"), n.cast("bigint"))


def permuted_epochs(df: DataFrame, epochs: list[int], key: str = "pair_id", seed: str = "42", ratio: float = 0.9,
                    num_partitions: int | None = None) -> DataFrame:
    """D1 + D2 for any number of epochs: ``split``, ``epoch`` and ``order`` of every row of ``df``, once an epoch.

    One exact rank (D0) splits the rows; each epoch's order inside a split is
    :func:`permuted` of the rank there, so epochs add rows but no Exchange.
    """
    r = rank_by_hash(df, key, seed, "_rank", total_col="_n", num_partitions=num_partitions)
    r = r.withColumn("_train", F.floor(F.lit(float(ratio)) * F.col("_n").cast("double")))
    train = F.col("_rank") < F.col("_train")
    r = r.withColumns({"split": F.when(train, F.lit("train")).otherwise(F.lit("validation")),
                       "_at": F.when(train, F.col("_rank")).otherwise(F.col("_rank") - F.col("_train")),
                       "_size": F.when(train, F.col("_train")).otherwise(F.col("_n") - F.col("_train"))})
    numbers = F.array(*[F.lit(int(e)).alias("epoch") for e in epochs])
    r = r.withColumn("_places", permuted(F.col("_at"), F.col("_size"), seed, epochs))
    return r.select(*df.columns, "split", F.inline(F.arrays_zip(numbers.alias("epoch"), F.col("_places").alias("order"))).alias("epoch", "order"))


def assign_batches(df: DataFrame, order_col: str = "order", split_col: str = "split", batch_size: int = 8,
                   val_batch_size: int = 1) -> DataFrame:
    """D3: ``batch_id = floor(order / batch_size)``; validation uses its own size.
    The last partial batch is kept."""
    bs = F.when(F.col(split_col) == "train", F.lit(batch_size)).otherwise(F.lit(val_batch_size))
    return df.withColumn("batch_id", F.floor(F.col(order_col) / bs).cast("bigint"))


def assign_steps(df: DataFrame, epoch_col: str = "epoch", batch_col: str = "batch_id", keep_col: str | None = None,
                 initial_step: int = 0, step_col: str = "step", batches_per_bucket: int = 1 << 20) -> DataFrame:
    """Dense global steps over the *surviving* batches ordered by
    (epoch, batch_id) (B3).  Rows of dropped batches get no step.  Buckets are
    ranges of ``batches_per_bucket`` batch ids inside an epoch."""
    rows = df if keep_col is None else df.where(F.col(keep_col))
    batches = rows.select(epoch_col, batch_col).distinct()
    ranked = exact_rank(batches, [epoch_col, batch_col],
                        [epoch_col, F.floor(F.col(batch_col) / F.lit(batches_per_bucket))], rank_col="_b")
    steps = ranked.select(epoch_col, batch_col, (F.col("_b") + F.lit(int(initial_step))).alias(step_col))
    return rows.join(steps, [epoch_col, batch_col])


def resume_point(latest: DataFrame) -> DataFrame:
    """``(initial_epoch, initial_step)`` from the latest artifact's
    ``(epoch, global_step)``; absent values count as -1 and 0 (B17).  Both come
    from one artifact: the one with the largest step."""
    best = F.max_by(F.struct("epoch", "global_step"), F.struct(F.coalesce("global_step", F.lit(-1)), "epoch"))
    agg = latest.agg(best.alias("_b")).select(F.col("_b.epoch").alias("_e"), F.col("_b.global_step").alias("_g"))
    return agg.select(
        (F.coalesce(F.col("_e"), F.lit(-1)) + 1).cast("int").alias("initial_epoch"),
        F.coalesce(F.col("_g"), F.lit(0)).cast("bigint").alias("initial_step"),
    )


def skip_finished(df: DataFrame, initial_epoch: int, epoch_col: str = "epoch") -> DataFrame:
    """D5 filter: epochs before the resume point are done."""
    return df.where(F.col(epoch_col) >= F.lit(int(initial_epoch)))


def validation_sample(df: DataFrame, steps: list[int], n: int = 2, key: str = "pair_id", seed: str = "42",
                      keep_col: str | None = "kept") -> DataFrame:
    """At each trigger step the validation loader is reshuffled; take the
    first ``n`` surviving rows of that order.

    ``steps`` is a driver list (bounded: the trigger steps of one run).  The
    rank filter lets Spark keep ``n`` rows of each step per task before the
    shuffle (window group limit), and a step's rows are first ranked inside
    hash parts, so no task gets all rows of a step.  A null key is a key like
    any other, and rows that repeat a key are rows of their own.
    """
    rows = df if keep_col is None else df.where(F.col(keep_col))
    cand = rows.withColumn("step", F.explode(F.array(*[F.lit(int(s)) for s in steps]))).withColumn(
        "_h", F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}:val:"), F.col("step").cast("string")))
    )
    # rows that repeat a key are told apart by their other columns
    ties = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind])
    picked = cand.withColumns({"_part": F.substring("_h", 32, 1), "_tie": ties})
    for by in (["step", "_part"], ["step"]):
        w = Window.partitionBy(*by).orderBy("_h", key, "_tie")
        picked = picked.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    others = [F.col(f"`{c}`") for c in rows.columns if c not in (key, "step")]
    return picked.select("step", key, (F.col("_rn") - 1).cast("int").alias("sample_idx"), *others)
