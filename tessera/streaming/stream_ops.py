"""ST1-ST3: Structured Streaming variants of the row-local steps.

Only row-local operators and ST1's windowed aggregate run on streams; the
global jobs (BPE training, exact ranks, BLEU counts) stay batch jobs.  The
streaming encoder is an Arrow batch function over a *frozen* vocabulary that
is broadcast once (bounded by ``vocab_size``), because the batch encoder's
regroup would be a stateful aggregate on a stream.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.config import UNK_ID
from tessera.operators.examples import build_examples
from tessera.operators.scoring import batch_predict
from tessera.functions.text import split_white_space
from tessera.operators.tokenizer import checked_rows
from tessera.session import scratch_path
from tessera.sources.artifacts import append_scalars


def stream_scalars(sdf: DataFrame, window: str = "1 hour", delay: str = "10 minutes", ts: str = "ts",
                   tag: str = "tag", value: str = "value") -> DataFrame:
    """ST1: per tumbling window and tag: count, mean and max of the logged
    values.  Rows older than the watermark (max event time - ``delay``) are
    dropped; a window is emitted once the watermark passes its end."""
    t = F.col(ts)
    if dict(sdf.dtypes).get(ts) == "timestamp_ntz":
        t = t.cast("timestamp")  # watermarks need TIMESTAMP, the files hold TIMESTAMP_NTZ
    d = sdf.withColumn(ts, t).withWatermark(ts, delay)
    return d.groupBy(F.window(ts, window).alias("w"), F.col(tag)).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max_value"),
    ).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        F.col(tag).alias("tag"),
        "n",
        "mean",
        "max_value",
    )


def frozen_vocab(spark: SparkSession, vocab: DataFrame):
    """Broadcast a vocabulary as a piece -> id dict; its size is checked first
    (a vocabulary is bounded by ``vocab_size``).  A larger one is joined by
    :func:`examples_per_batch` instead."""
    v = vocab.select("piece", "id")
    checked_rows(v, what="vocabulary")
    return spark.sparkContext.broadcast({r["piece"]: int(r["id"]) for r in v.collect()})


def _words(t: str) -> list:
    return split_white_space(t)


def rowwise_encoder(b_vocab, unk_id: int = UNK_ID):
    """A row-local word encoder (Arrow batches) over a broadcast vocabulary;
    splits words exactly as the batch encoder does."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def enc(s: pd.Series) -> pd.Series:
        v = b_vocab.value
        return s.map(lambda t: None if t is None else [v.get(w, unk_id) for w in _words(t)])

    return enc


def stream_examples(sdf: DataFrame, src_vocab, tgt_vocab, seq_len: int = 128, keep_dropped: bool = False) -> DataFrame:
    """ST2: F1 -> encode (frozen vocabularies) -> F2 -> E1-E4 as rows arrive."""
    es, et = rowwise_encoder(src_vocab), rowwise_encoder(tgt_vocab)
    enc = sdf.withColumn("src_ids", es(F.col("src_text"))).withColumn("tgt_ids", et(F.col("tgt_text")))
    return build_examples(enc, seq_len, keep_dropped=keep_dropped)


def examples_per_batch(sdf: DataFrame, src_vocab: DataFrame, tgt_vocab: DataFrame, path: str, seq_len: int = 128,
                       key: str = "pair_id", select=None, checkpoint: str | None = None):
    """ST2 with the batch encoder: every micro-batch runs the batch encode (the vocabularies are
    sent to the workers once) and E7 as an
    ordinary batch job through ``foreachBatch``.  Each batch overwrites its
    own folder ``batch=<id>``, so a replayed batch after a failure replaces
    its output instead of duplicating it.  Returns the started query."""
    from tessera.operators.tokenizer import encode_words, piece_dictionary

    src, tgt = (src_vocab, piece_dictionary(src_vocab)), (tgt_vocab, piece_dictionary(tgt_vocab))

    def write(batch_df: DataFrame, batch_id: int) -> None:
        enc = encode_words(batch_df, key, [("src_text", "src_ids", src), ("tgt_text", "tgt_ids", tgt)])
        ex = build_examples(enc, seq_len)
        if select is not None:
            ex = ex.select(*select)
        ex.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    ck = checkpoint or f"{path}/_checkpoint"
    return sdf.writeStream.foreachBatch(write).option("checkpointLocation", ck).trigger(availableNow=True).start()


def scalars_per_batch(path: str, run: str) -> Callable[[DataFrame, int], None]:
    """S7 from a stream: a function for ``foreachBatch`` that appends each micro-batch under its
    number, so a batch that is replayed replaces its own rows."""

    def write(batch_df: DataFrame, batch_id: int) -> None:
        append_scalars(batch_df, path, run=run, batch=batch_id)

    return write


def stream_predict(sdf: DataFrame, predictor_factory: Callable, text_col: str = "text") -> DataFrame:
    """ST3: I1's ``mapInPandas`` on a stream: requests in, predictions out."""
    return batch_predict(sdf, predictor_factory, text_col)


def run_to_table(sdf: DataFrame, name: str, output_mode: str = "append", partition_cols=None) -> DataFrame:
    """Run a stream over everything available (``availableNow``) into Parquet
    under the shared checkpoint folder and return that table as a batch
    DataFrame.  The sink commits per micro-batch, so a restarted query
    resumes from its checkpoint without duplicates."""
    spark = sdf.sparkSession
    base = scratch_path(spark, name)
    w = sdf.writeStream.format("parquet").outputMode(output_mode).option("checkpointLocation", f"{base}/_checkpoint")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    q = w.trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(sdf.schema).parquet(f"{base}/out")
