"""Near-duplicate embeddings: random hyperplanes, exact verification, components.

Equal vectors are one class.  Each class gets, in each of several tables, the
signs of its products with random hyperplanes; classes with equal signs in a
table are candidates.  Buckets are compared by matrix products in double
precision, the large ones in tiles, and each pair is counted in the first table
that brings it together.  Tasks pass on counts and the edges of a spanning
forest of what they found, never all pairs of a group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import stored
from tessera.llm.top_k import usable

THRESHOLD = 0.95
#: Planes a table at least; more where the vectors would fill the buckets beyond a tile.
BITS = 12
#: Part of the pairs at the threshold that no table may bring together.
MISS = 4e-4
#: Cosines this near to the threshold are summed again in one fixed way.
CLOSE = 1e-9
#: Vectors of a bucket that one tile compares; small buckets are packed to about as many.
TILE = 1024
SEED = 20


def bits_and_tables(n: int, threshold: float = THRESHOLD, miss: float = MISS, tile: int = TILE) -> tuple[int, int]:
    """Planes a table, so that ``n`` vectors in random directions fill a bucket with a tile at most, and tables.

    A pair at the threshold has equal signs at a plane with probability ``1 - acos(threshold) / pi`` (0.899
    at 0.95), so 12 planes take 24 tables for a miss of 4e-4, and 20 planes 62.
    """
    bits = min(30, max(BITS, math.ceil(math.log2(max(n, 1) / tile)))) if n > tile else BITS
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet)) if meet < 1 else 1


def _cosines(x: np.ndarray, threshold: float) -> np.ndarray:
    """Cosines of unit vectors; near the threshold they do not depend on the shape of the product."""
    out = x @ x.T
    for i, j in zip(*np.nonzero(np.abs(out - threshold) <= CLOSE)):
        out[i, j] = math.fsum((x[i] * x[j]).tolist())
    return out


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).normal(size=(dim, tables * bits))


def _signatures(tables: int, bits: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for dim in np.unique(np.asarray(batch.column("dim"))).tolist():
                part = batch.filter(pa.array(np.asarray(batch.column("dim")) == dim))
                x = np.asarray(part.column("vector").flatten()).astype(np.float64).reshape(-1, dim)
                sign = (x @ _planes(dim, tables, bits) > 0).reshape(len(x), tables, bits)
                keys = (sign.astype(np.int64) << np.arange(bits)).sum(axis=2).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "keys"])

    return run


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean matrix."""
    fresh = np.ones(len(links), bool)
    out = []
    for root in range(len(links)):
        if not fresh[root]:
            continue
        fresh[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            found = np.flatnonzero(links[u] & fresh)
            fresh[found] = False
            out += [(u, v) for v in found.tolist()]
            queue += found.tolist()
    return out


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        column = {name: table.column(name).combine_chunks() for name in table.column_names}
        ids = np.asarray(column["vec_id"]).astype(np.int64)
        weight = np.asarray(column["copies"]).astype(np.int64)
        x = np.asarray(column["vector"].flatten()).astype(np.float64).reshape(len(ids), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        keys = np.asarray(column["keys"].flatten()).reshape(len(ids), -1)
        bucket, side, t = np.asarray(column["bucket"]), np.asarray(column["side"]), int(column["t"][0].as_py())
        order = np.argsort(bucket, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(ids)]])
        a, b, found_ids, found = [], [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = order[lo:hi]
            if len(rows) < 2:
                continue
            links = _cosines(x[rows], threshold) >= threshold
            np.fill_diagonal(links, False)
            if side[rows].any():  # of a tile off the diagonal: pairs of two sides only
                links &= side[rows][:, None] != side[rows][None, :]
            if not links.any():
                continue
            if t:  # pairs that an earlier table has brought together are counted there
                for i in np.flatnonzero(links.any(axis=1)):
                    j = np.flatnonzero(links[i])
                    links[i, j] = ~(keys[rows[j], :t] == keys[rows[i], :t]).any(axis=1)
                if not links.any():
                    continue
            n = links @ weight[rows]
            some = np.flatnonzero(n)
            found_ids.append(ids[rows[some]])
            found.append(n[some])
            for u, v in _forest(links):
                a.append(ids[rows[u]])
                b.append(ids[rows[v]])
        one, more = np.concatenate(found_ids or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.concatenate([one, a]), "b": pa.array(np.concatenate([one, b]), pa.int64(), mask=np.arange(len(one) + len(b)) < len(one)),
                         "n": np.concatenate([more, np.zeros(len(a), np.int64)])})

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                 miss: float = MISS, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Links are pairs of rows with cosine of at least ``threshold`` in double
    precision.  Null or empty vectors, those that are zero and those with null or
    non-finite components link with nothing, nor do vectors of different
    lengths.  Rows that repeat an id are one vector in the result (the smallest
    of its usable ones); rows with a null id each stay, unlinked and kept.  An empty
    table gives an empty one; other columns are ignored, whatever their names.  A pair at the
    threshold is missed with probability ``miss``, a nearer one less often.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    every = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector"))
    fit = usable(F.col("vector")) & F.exists(F.col("vector"), lambda x: x != 0)
    every = every.select("vec_id", F.when(fit, F.transform("vector", lambda x: x + F.lit(0.0))).alias("vector"))
    none = every.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                                               F.lit(True).alias("kept"))
    every = every.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    named = stored(every.select("vec_id", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("mark"), "vector"), "vectors")
    whole = named.where("vector IS NOT NULL")
    classes = stored(whole.groupBy("mark", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")

    reps = classes.select(F.col("rep").alias("vec_id"), "copies", "vector", F.size("vector").alias("dim"))
    n = reps.count()
    bits, tables = bits_and_tables(n, threshold, miss, tile)
    signed = stored(reps.mapInArrow(_signatures(tables, bits), "vec_id long, copies long, vector array<double>, dim int, keys array<int>"), "signed")
    placed = signed.select("*", F.posexplode("keys").alias("t", "bucket"))
    sizes = placed.groupBy("dim", "t", "bucket").agg(F.count("*").alias("size"))
    placed = signed.select("*", F.posexplode("keys").alias("t", "bucket")).join(
        stored(sizes.where(F.col("size") > tile), "large"), ["dim", "t", "bucket"], "left")
    parts = F.coalesce(F.ceil(F.col("size") / tile), F.lit(1)).cast("int")
    placed = placed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    # a large bucket: tiles (i, j) with i <= j; a row goes to those of its own part
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        F.least(F.col("part"), o).alias("i"), F.greatest(F.col("part"), o).alias("j"),
        F.when(F.col("part") == o, 0).when(F.col("part") < o, 1).otherwise(2).alias("side")))
    dealt = placed.withColumn("tile", F.explode(tiles))
    packs = max(1, math.ceil(n / tile))
    pack = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(-1 - F.col("bucket").cast("long"))
    found = dealt.select("vec_id", "copies", "vector", "dim", "keys", "t", "bucket", pack.alias("pack"), "tile.*").groupBy(
        "dim", "t", "pack", "i", "j").applyInArrow(_compare(threshold), "a long, b long, n long")
    found = stored(found, "found")

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    per_class = classes.select("mark", "vector", "rep", "copies").join(counts, "rep", "left").join(
        joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "mark", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    per_class = stored(per_class, "per_class")
    out = named.join(per_class, ["mark", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(none)
