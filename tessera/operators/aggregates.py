"""A1-A5: lengths, sizes, batch counts, the preparation report, latest scalar.

Each is a single ``groupBy().agg`` with conditional sums, so it is one
partial aggregate per task plus a shuffle of a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def max_lengths(df: DataFrame, src_len: str = "src_len", tgt_len: str = "tgt_len", by: list[str] | None = None) -> DataFrame:
    """A1 (B6): maximum token length per side over *all* rows, before filtering."""
    aggs = [F.max(src_len).cast("int").alias("max_src_len"), F.max(tgt_len).cast("int").alias("max_tgt_len")]
    return df.groupBy(*(by or [])).agg(*aggs)


def dataset_size(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A2: row count of the dataset or of each split."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def batch_count(df: DataFrame, batch_size_col, batch_col: str = "batch_id", keep_col: str = "kept",
                by: list[str] | None = None) -> DataFrame:
    """A3: ``ceil(n / batch_size)`` batches, and those with a surviving row."""
    bs = F.col(batch_size_col) if isinstance(batch_size_col, str) else batch_size_col
    return df.groupBy(*(by or [])).agg(
        F.ceil(F.count(F.lit(1)) / F.max(bs)).cast("bigint").alias("n_batches"),
        F.count_distinct(F.when(F.col(keep_col), F.col(batch_col))).cast("bigint").alias("n_batches_kept"),
    )


def prep_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A4 (flagship): per split -- rows, kept, dropped by reason, max lengths
    (over all rows, B6), kept tokens per side, non-pad label tokens, batches
    cut and batches that survive the filter (B2)."""
    by = by or ["split"]
    k = F.col("kept")

    def n_reason(r):
        return F.sum((F.col("drop_reason") == r).cast("int")).cast("bigint").alias(f"n_{r}")

    return df.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.sum(k.cast("int")).cast("bigint").alias("n_kept"),
        n_reason("src_long"),
        n_reason("tgt_long"),
        n_reason("both"),
        n_reason("null_text"),
        F.max("src_len").cast("int").alias("max_src_len"),
        F.max("tgt_len").cast("int").alias("max_tgt_len"),
        F.sum(F.when(k, F.col("src_len"))).cast("bigint").alias("src_tokens"),
        F.sum(F.when(k, F.col("tgt_len"))).cast("bigint").alias("tgt_tokens"),
        F.sum(F.when(k, F.col("tgt_len") + 1)).cast("bigint").alias("label_tokens"),
        (F.max("batch_id") + 1).cast("bigint").alias("n_batches"),
        F.count_distinct(F.when(k, F.col("batch_id"))).cast("bigint").alias("n_batches_kept"),
    )


def latest_scalar(df: DataFrame, tag: str = "tag", step: str = "step", value: str = "value") -> DataFrame:
    """A5: the value at the largest step of every tag (``max_by`` combines map side)."""
    return df.groupBy(tag).agg(
        F.max(step).alias("last_step"),
        F.max_by(value, step).alias("last_value"),
    )
