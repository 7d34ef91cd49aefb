"""Streaming operators and batch scoring."""

import time

from pyspark.sql import functions as F

from tessera.operators import scoring
from tessera.streaming import stream_ops as S


def test_batch_predict_reports_errors(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None)], "k bigint, text string")
    out = {r.k: (r.prediction, r.status) for r in scoring.batch_predict(df, scoring.reverse_words_factory).collect()}
    assert out[1] == ("c b a", "ok") and out[2] == (None, "error") and out[3] == (None, "error")


def test_late_row_is_dropped(spark, tmp_dir):
    schema = "tag string, value double, ts timestamp"
    src = f"{tmp_dir}/in"
    first = [("a", 1.0, "2024-01-01 00:05:00"), ("a", 2.0, "2024-01-01 03:00:00")]
    late = [("a", 100.0, "2024-01-01 00:30:00"), ("a", 5.0, "2024-01-01 05:00:00")]
    spark.createDataFrame(first, "tag string, value double, ts string").select(
        "tag", "value", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{src}/b0")
    sdf = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    base = f"{tmp_dir}/out"
    q = (S.stream_scalars(sdf, "1 hour", "10 minutes").writeStream.format("parquet")
         .option("checkpointLocation", f"{base}/_ck").trigger(availableNow=True).start(f"{base}/data"))
    q.awaitTermination()
    time.sleep(1)
    spark.createDataFrame(late, "tag string, value double, ts string").select(
        "tag", "value", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{src}/b1")
    q = (S.stream_scalars(sdf, "1 hour", "10 minutes").writeStream.format("parquet")
         .option("checkpointLocation", f"{base}/_ck").trigger(availableNow=True).start(f"{base}/data"))
    q.awaitTermination()
    rows = {str(r.window_start): (r.n, r.max_value) for r in spark.read.parquet(f"{base}/data").collect()}
    # the 00:00 window closed when the watermark passed 01:00; the late 00:30 row is gone
    assert rows["2024-01-01 00:00:00"] == (1, 1.0)
    assert rows["2024-01-01 03:00:00"] == (1, 2.0)


def test_stream_examples_match_batch(spark, tmp_dir):
    from tessera.operators import examples, tokenizer

    rows = [(i, f"w{i % 5} x y", f"t{i % 3} z") for i in range(40)]
    df = spark.createDataFrame(rows, "pair_id bigint, src_text string, tgt_text string")
    vs, vt = tokenizer.fit_word_vocab(df, "src_text", 12), tokenizer.fit_word_vocab(df, "tgt_text", 12)
    batch = examples.build_examples(
        tokenizer.encode_words(df, "pair_id", [("src_text", "src_ids", vs), ("tgt_text", "tgt_ids", vt)]), 16)
    df.repartition(3).write.parquet(f"{tmp_dir}/in")
    sdf = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in")
    ex = S.stream_examples(sdf, S.frozen_vocab(spark, vs), S.frozen_vocab(spark, vt), 16)
    out = S.run_to_table(ex.select("pair_id", "encoder_input", "label"), "t-st2")
    a = {r.pair_id: (r.encoder_input, r.label) for r in out.collect()}
    b = {r.pair_id: (r.encoder_input, r.label) for r in batch.collect()}
    assert a == b


def _batcher_factory():
    # defined inside the factory so the worker receives it by value
    class Batcher:
        """Batch predictor that fails whole batches containing 'boom'."""

        def predict_batch(self, texts):
            if any(t == "boom" for t in texts):
                raise RuntimeError("batch failed")
            return [t.upper() for t in texts]

        def predict(self, t):
            if t == "boom":
                raise RuntimeError("bad row")
            return t.upper()

    return Batcher()


def test_batch_predictor_falls_back_to_rows(spark):
    import sys

    from pyspark import cloudpickle

    # the worker cannot import this test module: ship its functions by value
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([(1, "ab"), (2, "boom"), (3, "cd")], "k bigint, text string").coalesce(1)
    out = {r.k: (r.prediction, r.status, r.error) for r in scoring.batch_predict(df, _batcher_factory).collect()}
    assert out[1] == ("AB", "ok", None) and out[3] == ("CD", "ok", None)
    assert out[2][0] is None and out[2][1] == "error" and "bad row" in out[2][2]
