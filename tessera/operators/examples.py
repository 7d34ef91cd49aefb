"""Training examples and collated batches.

E7 is one projection over already encoded rows: no shuffle.  E9 groups at
most ``batch_size`` rows, so no group can grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import EOS_ID, PAD_ID, SOS_ID
from tessera.functions import arrays as A
from tessera.operators.checks import drop_reason

EXAMPLE_COLS = (
    "pair_id",
    "src_text",
    "tgt_text",
    "src_len",
    "tgt_len",
    "encoder_input",
    "decoder_input",
    "label",
    "encoder_mask",
    "decoder_valid_len",
)


def build_examples(df: DataFrame, seq_len: int, src_ids: str = "src_ids", tgt_ids: str = "tgt_ids",
                   sos: int = SOS_ID, eos: int = EOS_ID, pad: int = PAD_ID, keep_dropped: bool = False,
                   expand_decoder_mask: bool = False) -> DataFrame:
    """Lengths, F2 tag, E1-E4 arrays and the compact E6 mask for each kept row.

    ``decoder_valid_len`` is exact when padding is a suffix; rows whose target
    holds the pad id itself also carry ``decoder_pad_mask`` (NULL otherwise)."""
    d = df.withColumn("src_len", F.size(src_ids)).withColumn("tgt_len", F.size(tgt_ids))
    # size(NULL) is -1 in legacy mode; treat a missing text as NULL length
    d = d.withColumn("src_len", F.when(F.col(src_ids).isNull(), None).otherwise(F.col("src_len")).cast("int"))
    d = d.withColumn("tgt_len", F.when(F.col(tgt_ids).isNull(), None).otherwise(F.col("tgt_len")).cast("int"))
    d = d.withColumn("drop_reason", drop_reason("src_len", "tgt_len", seq_len)).withColumn(
        "kept", F.col("drop_reason").isNull()
    )
    k = F.col("kept")
    d = (
        d.withColumn("encoder_input", F.when(k, A.encoder_input(src_ids, seq_len, sos, eos, pad)))
        .withColumn("decoder_input", F.when(k, A.decoder_input(tgt_ids, seq_len, sos, pad)))
        .withColumn("label", F.when(k, A.label(tgt_ids, seq_len, eos, pad)))
        .withColumn("encoder_mask", F.when(k, A.pad_mask("encoder_input", pad)))
        .withColumn("decoder_valid_len", F.when(k, F.col("tgt_len") + 1))
        # A literal [PAD] word puts the pad id inside the target; for such
        # rows the length form is not exact, so the explicit E4 mask is kept
        .withColumn(
            "decoder_pad_mask",
            F.when(k & F.array_contains(F.col(tgt_ids), F.lit(pad)), A.pad_mask("decoder_input", pad)),
        )
    )
    if expand_decoder_mask:
        d = d.withColumn("decoder_mask", F.when(k, A.decoder_mask("decoder_input", pad)))
    return d if keep_dropped else d.where(k)


def _field(name: str):
    return lambda x: x[name]


def collate(df: DataFrame, group_cols=("split", "epoch", "batch_id"), order_col: str = "order",
            fields=("pair_id", "encoder_input", "decoder_input", "label", "encoder_mask", "decoder_valid_len",
                    "src_text", "tgt_text")) -> DataFrame:
    """One row per batch with stacked fields in batch order."""
    cols = [c for c in group_cols if c in df.columns]
    st = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("_o"), *[F.col(f) for f in fields])))
    g = df.groupBy(*cols).agg(st.alias("_rows"))
    return g.select(
        *cols,
        F.size("_rows").alias("n_rows"),
        *[F.transform("_rows", _field(f)).alias(f) for f in fields],
    )
