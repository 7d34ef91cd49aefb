"""Registered streaming queries: each streams the given tables (or files Spark
derives from them) through a query with an ``availableNow`` trigger and
returns the committed output as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import scoring, tokenizer
from tessera.session import scratch_path
from tessera.sources import fixtures as fx
from tessera.streaming import stream_ops as S

WORD_VOCAB = 2000


def _as_files(df, name: str):
    """Write a derived table, as partitioned as it is, to stream from."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def q_st1_stream_scalars(spark, d):
    schema = fx.read_table(spark, d, "events").schema
    # a file stream reads folders; the table may be one file or a folder of part files, and a glob takes either
    sdf = spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/events.parque[t]")
    sdf = sdf.select(F.col("event_type").alias("tag"), "value", "ts")
    out = S.run_to_table(S.stream_scalars(sdf, "1 hour", "10 minutes"), "st1")
    return out.withColumn("mean", F.round("mean", 6))


def q_st2_stream_examples(spark, d):
    lp = fx.line_pairs(spark, d)
    vs = tokenizer.fit_word_vocab(lp, "src_text", WORD_VOCAB).persist()
    vt = tokenizer.fit_word_vocab(lp, "tgt_text", WORD_VOCAB).persist()
    path = _as_files(lp, "st2-in")
    sdf = spark.readStream.schema(lp.schema).option("maxFilesPerTrigger", 8).parquet(path)
    cols = [
        "pair_id", "src_len", "tgt_len",
        A.join_ints("encoder_input").alias("encoder_input"),
        A.join_ints("decoder_input").alias("decoder_input"),
        A.join_ints("label").alias("label"),
        A.join_ints("encoder_mask").alias("encoder_mask"),
        "decoder_valid_len",
    ]
    out = scratch_path(spark, "st2")
    q = S.examples_per_batch(sdf, vs, vt, f"{out}/data", 128, select=cols, checkpoint=f"{out}/_checkpoint")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{out}/data").drop("batch")


def q_st2_stream_examples_rowwise(spark, d):
    lp = fx.line_pairs(spark, d)
    vs = S.frozen_vocab(spark, tokenizer.fit_word_vocab(lp, "src_text", WORD_VOCAB))
    vt = S.frozen_vocab(spark, tokenizer.fit_word_vocab(lp, "tgt_text", WORD_VOCAB))
    path = _as_files(lp, "st2r-in")
    sdf = spark.readStream.schema(lp.schema).option("maxFilesPerTrigger", 8).parquet(path)
    ex = S.stream_examples(sdf, vs, vt, 128)
    return S.run_to_table(ex.select(
        "pair_id", "src_len", "tgt_len",
        A.join_ints("encoder_input").alias("encoder_input"),
        A.join_ints("decoder_input").alias("decoder_input"),
        A.join_ints("label").alias("label"),
        A.join_ints("encoder_mask").alias("encoder_mask"),
        "decoder_valid_len",
    ), "st2r")


def q_st3_stream_predict(spark, d):
    cp = fx.conv_pairs(spark, d).select("pair_id", F.col("src_text").alias("text"))
    path = _as_files(cp, "st3-in")
    sdf = spark.readStream.schema(cp.schema).option("maxFilesPerTrigger", 8).parquet(path)
    out = S.run_to_table(S.stream_predict(sdf, scoring.reverse_words_factory), "st3")
    return out.select("pair_id", "prediction", "status", "error")


def queries() -> dict:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
