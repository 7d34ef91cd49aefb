"""Softmax-weighted lookup of queries in a table of keys and values.

For each query ``q``: scores ``q . k / sqrt(d)`` over all keys (of its block),
masked keys at ``MASKED``, softmax over the scores, and the sum of the values
with these weights.  No (query, key) pair becomes a row: tiles of queries and
keys meet in a task as matrices, and a tile leaves one *state* a query -- the
largest score, the sum of exponentials below it and the values summed with them.
States merge in any order (as a sum does, after both are brought to the larger
of their maxima), so they are folded in a tree of ``FAN`` at a time and the size of the
tiles does not matter for the result.

The work is queries x keys of a block, whatever its plan; the shuffle moves a query
once a key tile of its block and a key once a query tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: Score of a masked key (fixed value): it keeps a weight when all keys are masked.
MASKED = -1e9
#: Queries and keys of a tile.
TILE = 1024
#: States that one fold merges.
FAN = 16

STATE = "block string, query_id bigint, row bigint, tile bigint, m double, s double, w array<double>"


def _matrix(column: pa.Array, dim: int, what: str) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(flat) != len(column) * dim:
        raise ValueError(f"{what} of different lengths in one lookup")
    return flat.reshape(len(column), dim)


def _fold_tile(table: pa.Table) -> pa.Table:
    """The state of each query of the tile over the keys of the tile."""
    names = [f.split()[0] for f in STATE.split(", ")]
    rows = table.combine_chunks()
    asks = rows.column("asks")
    queries, keys = rows.filter(asks), rows.filter(pc.invert(asks))
    if not queries.num_rows or not keys.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(),
                                                                  pa.list_(pa.float64()))], names)
    first = queries.column("vector").combine_chunks()
    dim = len(first[0])
    q = _matrix(first, dim, "vectors")
    k = _matrix(keys.column("vector").combine_chunks(), dim, "vectors")
    values = keys.column("value").combine_chunks()
    v = _matrix(values, len(values[0]), "values")
    scores = q @ k.T / math.sqrt(dim)
    scores[:, np.asarray(keys.column("masked"))] = MASKED
    m = scores.max(axis=1)
    e = np.exp(scores - m[:, None])
    w = e @ v
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * v.shape[1], pa.int32()), pa.array(w.ravel()))
    return pa.Table.from_arrays([queries.column("block"), queries.column("query_id"), queries.column("row"), queries.column("kt"),
                                 pa.array(m), pa.array(e.sum(axis=1)), lists], names)


def _fold_states(states: DataFrame, by: list[str]) -> DataFrame:
    """Merge the states of the same ``by``; lists hold ``FAN`` entries at most."""
    grouped = states.groupBy(*by).agg(F.max("m").alias("_m"), F.collect_list(F.struct("m", "s", "w")).alias("_of"))
    s = F.expr("aggregate(_of, 0D, (a, x) -> a + x.s * exp(x.m - _m))")
    w = F.expr("aggregate(_of, array_repeat(0D, size(_of[0].w)), (a, x) -> zip_with(a, x.w, (p, y) -> p + y * exp(x.m - _m)))")
    return grouped.select(*by, F.col("_m").alias("m"), s.alias("s"), w.alias("w"))


def _usable(vector: Column) -> Column:
    """Not null or empty, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def softmax_lookup(queries: DataFrame, keys: DataFrame, query_id: str = "vec_id", key_id: str = "vec_id", vector: str = "embedding",
                   value: str | None = None, mask: str | None = None, block: str | None = None, tile: int = TILE) -> DataFrame:
    """``[block,] query_id, weighted, log_sum``: the softmax-weighted sum of the values, and the log of the exponentials' sum.

    ``mask`` names a boolean column of ``keys``: keys where it is false score ``MASKED``
    (null counts as true).  Without ``value`` the key's vector is its value.  With ``block`` (a
    column of both tables) a query meets the keys of its own block; a null block is
    a block like any other.  Keys with an unusable vector or value (null, empty, or with a null or
    non-finite component) take no part; a query with an unusable vector, or without any key in its
    block, has nulls.  Queries that repeat id, block and vector are one; vectors of different
    lengths in one tile are an error.
    """
    spark = queries.sparkSession

    def named(df: DataFrame, id_col: str, *more: Column) -> DataFrame:
        b = F.lit("") if block is None else F.col(f"`{block}`").cast("string")
        return df.select(b.alias("block"), F.col(f"`{id_col}`").cast("bigint").alias("query_id"),
                         F.col(f"`{vector}`").cast("array<double>").alias("vector"), *more)

    asked = named(queries, query_id).withColumn("row", F.xxhash64("block", "query_id", "vector")).dropDuplicates(["block", "query_id", "row"])
    path = scratch_path(spark, "lookup-queries")
    asked.write.parquet(path)  # read three times below
    asked = spark.read.schema(asked.schema).parquet(path)
    known = named(keys, key_id, F.col(f"`{value or vector}`").cast("array<double>").alias("value"),
                  (F.lit(False) if mask is None else ~F.coalesce(F.col(f"`{mask}`"), F.lit(True))).alias("masked"))
    known = known.where(_usable(F.col("vector")) & _usable(F.col("value"))).withColumn("row", F.xxhash64("query_id", "vector", "value"))
    q, k = asked.where(_usable(F.col("vector"))), known

    def tiles(df: DataFrame, name: str) -> DataFrame:
        """Tiles that a block's rows are dealt to: one row a block."""
        return df.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("bigint").alias(name))

    counts = tiles(q, "n_q").join(tiles(k, "n_k").withColumnRenamed("block", "_b"), F.col("block").eqNullSafe(F.col("_b"))).drop("_b")
    counts = counts.withColumnRenamed("block", "_block")

    def dealt(df: DataFrame, asks: bool) -> DataFrame:
        """Rows with their tile, once for each tile of the other side."""
        own, other = ("n_q", "n_k") if asks else ("n_k", "n_q")
        rows = df.join(counts, F.col("block").eqNullSafe(F.col("_block")))
        mine = F.pmod(F.xxhash64(F.lit("tile"), "row"), F.col(own))
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))
        value_col = F.lit(None).cast("array<double>") if asks else F.col("value")
        masked = F.lit(False) if asks else F.col("masked")
        rows = rows.select("block", "query_id", "row", "vector", value_col.alias("value"), masked.alias("masked"), F.lit(asks).alias("asks"),
                           F.col("n_k"), mine.alias("_mine"), each.alias("_other"))
        qt, kt = ("_mine", "_other") if asks else ("_other", "_mine")
        return rows.withColumns({"qt": F.col(qt), "kt": F.col(kt)}).drop("_mine", "_other")

    both = dealt(q, True).unionByName(dealt(k, False))
    most = counts.agg(F.max("n_k")).first()[0] or 0
    states = both.drop("n_k").groupBy("block", "qt", "kt").applyInArrow(_fold_tile, STATE)
    width = most
    while width > 1:
        width = math.ceil(width / FAN)
        states = _fold_states(states.withColumn("tile", F.floor(F.col("tile") / FAN)), ["block", "query_id", "row", "tile"])
    done = states.select(F.col("block").alias("_b"), F.col("query_id").alias("_q"), F.col("row").alias("_r"),
                         F.transform("w", lambda x: x / F.col("s")).alias("weighted"), (F.col("m") + F.log("s")).alias("log_sum"))
    out = asked.join(done, F.col("block").eqNullSafe(F.col("_b")) & F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("row") == F.col("_r")), "left")
    first = [] if block is None else [F.col("block").alias(block)]
    return out.select(*first, "query_id", "weighted", "log_sum")
