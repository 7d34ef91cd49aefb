"""Filters and data checks.

Checks are one ``agg`` each (partial aggregation, one tiny shuffle); strict
variants fail the job through ``raise_error`` instead of collecting rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import SPECIAL_PIECES
from tessera.functions.text import has_literal_special

DROP_REASONS = ("src_long", "tgt_long", "both", "null_text")


def drop_reason(src_len, tgt_len, seq_len: int):
    """B1: keep iff ``src_len <= seq_len-2`` and ``tgt_len <= seq_len-1``
    (bounds inclusive); NULL lengths (missing text) give ``null_text``."""
    s, t = F.col(src_len), F.col(tgt_len)
    s_long = s > F.lit(seq_len - 2)
    t_long = t > F.lit(seq_len - 1)
    return (
        F.when(s.isNull() | t.isNull(), F.lit("null_text"))
        .when(s_long & t_long, F.lit("both"))
        .when(s_long, F.lit("src_long"))
        .when(t_long, F.lit("tgt_long"))
    )


def length_filter(df: DataFrame, seq_len: int, src_len: str = "src_len", tgt_len: str = "tgt_len",
                  keep_dropped: bool = False) -> DataFrame:
    """tag rows with ``drop_reason`` (NULL = kept); drop them unless asked."""
    out = df.withColumn("drop_reason", drop_reason(src_len, tgt_len, seq_len)).withColumn(
        "kept", F.col("drop_reason").isNull()
    )
    return out if keep_dropped else out.where(F.col("kept"))


def drop_empty(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """drop empty samples (NULL in any of ``cols``) -- and with them the
    batches left without a row, which simply no longer appear."""
    cols = cols or ["encoder_input"]
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def check_shapes(df: DataFrame, seq_len: int, cols=("encoder_input", "decoder_input", "label"),
                 strict: bool = False) -> DataFrame:
    """every example array has exactly ``seq_len`` items.  Returns one row
    ``(n_rows, n_bad)``; ``strict`` raises inside the job instead."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | (F.coalesce(F.size(c), F.lit(-1)) != F.lit(seq_len))
    out = df.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.sum(bad.cast("int")).cast("bigint").alias("n_bad"),
    ).select("n_rows", F.coalesce("n_bad", F.lit(0)).cast("bigint").alias("n_bad"))
    if strict:
        out = out.select(
            "n_rows",
            F.when(F.col("n_bad") > 0, F.raise_error(F.lit("example arrays do not have seq_len items")))
            .otherwise(F.col("n_bad")).cast("bigint").alias("n_bad"),
        )
    return out


def check_vocab(ids_df: DataFrame, vocab: DataFrame, ids_col: str = "ids", specials=SPECIAL_PIECES,
                strict: bool = False) -> DataFrame:
    """Q1: ids inside ``[0, vocab_size)`` and every special present.

    ``strict`` fails the job instead where a special is missing or an id is
    outside (B10).  Both sides reduce to one row before they meet, so the join is 1 x 1.
    """
    ids = ids_df.agg(
        F.min(F.array_min(ids_col)).alias("min_id"),
        F.max(F.array_max(ids_col)).alias("max_id"),
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.lit(1).alias("_j"),
    )
    vs = vocab.agg(
        F.count(F.lit(1)).cast("bigint").alias("vocab_size"),
        F.sum(F.col("piece").isin(list(specials)).cast("int")).cast("bigint").alias("n_specials"),
        F.lit(1).alias("_j"),
    )
    j = ids.join(vs, "_j")
    out = j.select(
        "n_rows",
        "vocab_size",
        "min_id",
        "max_id",
        ((F.coalesce(F.col("min_id"), F.lit(0)) >= 0) & (F.coalesce(F.col("max_id"), F.lit(-1)) < F.col("vocab_size"))).alias(
            "ids_in_range"
        ),
        (F.col("n_specials") == F.lit(len(specials))).alias("specials_present"),
    )
    if strict:
        fail = F.raise_error(F.lit("the vocabulary lacks a special piece or an id is outside it")).cast("boolean")
        out = out.withColumn("specials_present", F.when(F.col("specials_present") & F.col("ids_in_range"), F.lit(True)).otherwise(fail))
    return out


def check_literal_specials(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q2: rows whose text holds a special piece literally (B24), per column."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n_rows")]
    for c in cols:
        aggs.append(F.sum(has_literal_special(c).cast("int")).cast("bigint").alias(f"n_special_{c}"))
    out = df.agg(*aggs)
    return out.select("n_rows", *[F.coalesce(F.col(f"n_special_{c}"), F.lit(0)).alias(f"n_special_{c}") for c in cols])
