"""Connected components of an edge table, by contraction rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``id, component_id`` (smallest id that is reachable) for every id in ``edges`` (a, b: long).

    In each round every vertex moves to the least of its neighbours and
    itself, in an order given by a hash, and the edges between what is left
    stay for the next round; with a random order the edges left shrink by a
    constant factor, whatever the shape (a star goes in one round).  All tables
    are written to the shared folder, and each join reads written tables on
    both sides, so that Spark can split the rows of a vertex with many edges.
    Vertices without edges are not in the result; null ends are left out.
    """

    def node(name: str):
        return F.struct(F.xxhash64(F.lit("order"), F.col(name)).alias("h"), F.col(name).alias("id"))

    left = edges.where("a <> b").select(node("a").alias("a"), node("b").alias("b")).distinct()
    left = stored(left, "edges")
    labels = stored(left.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("root")), "labels")
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        moves = both.groupBy(F.col("e.a").alias("u")).agg(F.min("e.b").alias("m"))
        moves = stored(moves.select("u", F.least("u", "m").alias("to")), "moves")
        first = left.join(moves, left.a == moves.u).select(F.col("to").alias("a"), "b")
        second = first.join(moves, first.b == moves.u).select("a", F.col("to").alias("b"))
        left = stored(second.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        labels = stored(labels.join(moves, labels.root == moves.u, "left").select(
            "v", F.coalesce("to", "root").alias("root")), "labels")
    least = stored(labels.groupBy("root").agg(F.min("v.id").alias("component_id")), "least")
    return labels.join(least, "root").select(F.col("v.id").alias("id"), "component_id")
