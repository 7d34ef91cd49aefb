"""Same results with 1, 4 and 64 shuffle partitions."""

from pyspark.sql import functions as F

from tessera.config import PrepConfig
from tessera.operators import bpe, examples, ordering
from tessera.plans import prep

TEXTS = [f"the {w} lower tower {w}er newest" for w in ("aa", "ab", "ba", "bb", "abc", "cab", "bca")] * 6


def _with_parts(spark, n, fn):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        return fn()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_encode_and_collate_partition_independent(spark):
    df = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(TEXTS)], "pair_id bigint, src_text string, tgt_text string")
    vocab, merges, _ = bpe.train_bpe(df, "src_text", 50)
    vocab, merges = vocab.cache(), merges.cache()

    def run():
        enc = {r.pair_id: r.ids for r in bpe.encode(df, "pair_id", "src_text", vocab, merges).collect()}
        p = prep.prepare(df, PrepConfig(seq_len=32, batch_size=4)).where(F.col("kept"))
        col = {(r.split, r.batch_id): r.pair_id for r in examples.collate(p, ("split", "batch_id"), "order", ("pair_id",)).collect()}
        steps = ordering.assign_steps(
            ordering.assign_batches(ordering.epoch_orders(df.withColumn("split", F.lit("train")), [0, 1], by=["split"]), "order",
                                    "split", 4),
        ).select("pair_id", "epoch", "step").collect()
        return enc, col, sorted(tuple(r) for r in steps)

    results = [_with_parts(spark, n, run) for n in (1, 4, 64)]
    assert results[0] == results[1] == results[2]
