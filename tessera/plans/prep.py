"""The corpus preparation plan and its report (flagship, A4).

    pairs -> fit vocabularies (all rows, B5) -> encode -> lengths, F2 tag
          -> D1 split (rank over all rows) -> D2 epoch order inside the split
          -> D3 batches (cut before the filter, B2) -> E1-E4 arrays -> A4

Ranks are computed on the slim key table and joined onto the encoded rows,
so the texts and arrays are shuffled once (the encode regroup), not once per
rank.  The report needs only token counts: with the word tokenizer every
word is exactly one id, so it counts words and skips the vocabulary fit and
the encode; a subword encoder is run in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import PrepConfig
from tessera.functions.text import n_words
from tessera.operators import aggregates, ordering, tokenizer
from tessera.operators.checks import drop_reason
from tessera.operators.examples import build_examples


def fit_vocabs(pairs: DataFrame, cfg: PrepConfig, train_only: DataFrame | None = None):
    """Word vocabularies for both sides, fitted on all rows (B5) unless
    ``cfg.fit_on == 'train'`` and the train rows are given."""
    base = train_only if (cfg.fit_on == "train" and train_only is not None) else pairs
    vs = tokenizer.fit_word_vocab(base, "src_text", cfg.vocab_size)
    vt = tokenizer.fit_word_vocab(base, "tgt_text", cfg.vocab_size)
    return vs, vt


def encode_pairs(pairs: DataFrame, vs: DataFrame, vt: DataFrame, key: str = "pair_id") -> DataFrame:
    return tokenizer.encode_words(pairs, key, [("src_text", "src_ids", vs), ("tgt_text", "tgt_ids", vt)])


def _train_rows(pairs: DataFrame, cfg: PrepConfig, key: str, num_partitions: int | None = None):
    """The rows of the train split, where vocabularies are to be fitted on them alone."""
    if cfg.fit_on != "train":
        return None
    sp = ordering.split_pairs(pairs.select(key), key=key, seed=cfg.seed, ratio=cfg.train_ratio, num_partitions=num_partitions)
    return pairs.join(sp.where("split = 'train'").select(key), key, "left_semi")


def encode_kept(pairs: DataFrame, vs: DataFrame, vt: DataFrame, cfg: PrepConfig, key: str = "pair_id") -> DataFrame:
    """Example rows of all pairs; only those that the length filter keeps are encoded.

    A word is one id, so the lengths, and with them the drop reasons of all
    rows (B6), are known before the encode.
    """
    lens = {"_sl": n_words("src_text").cast("int"), "_tl": n_words("tgt_text").cast("int")}
    d = pairs.withColumns(lens).withColumn("_why", drop_reason("_sl", "_tl", cfg.seq_len))
    d = d.withColumns({"_src": F.col("src_text"), "_tgt": F.col("tgt_text")})
    d = d.withColumns({c: F.when(F.col("_why").isNull(), F.col(c)) for c in ("src_text", "tgt_text")})
    ex = build_examples(encode_pairs(d, vs, vt, key), cfg.seq_len, keep_dropped=True)
    ex = ex.withColumns({"src_text": F.col("_src"), "tgt_text": F.col("_tgt"), "src_len": F.col("_sl"), "tgt_len": F.col("_tl"),
                         "drop_reason": F.col("_why"), "kept": F.col("_why").isNull()})
    return ex.drop("_src", "_tgt", "_sl", "_tl", "_why")


def bpe_encoder(src_model, tgt_model, key: str = "pair_id"):
    """An encoder for :func:`prepare` from two BPE models ``(vocab, merges)``."""
    from tessera.operators import bpe

    def enc(pairs: DataFrame) -> DataFrame:
        e = bpe.encode(pairs, key, "src_text", *src_model, out_col="src_ids")
        return bpe.encode(e, key, "tgt_text", *tgt_model, out_col="tgt_ids")

    return enc


def rank_keys(keys: DataFrame, cfg: PrepConfig, key: str = "pair_id", epoch: int = 0,
              num_partitions: int | None = None) -> DataFrame:
    """D1 + D2 + D3 on the slim key table: ``(key, split, split_rank, order, batch_id)``.

    Ranks depend only on the key, so they never move the texts or arrays."""
    sp = ordering.split_pairs(keys, key=key, seed=cfg.seed, ratio=cfg.train_ratio, num_partitions=num_partitions)
    od = ordering.shuffle(sp, key=key, seed=cfg.seed, epoch=epoch, by=["split"], num_partitions=num_partitions)
    return ordering.assign_batches(od, "order", "split", cfg.batch_size, cfg.val_batch_size)


def prepare(pairs: DataFrame, cfg: PrepConfig = PrepConfig(), vocabs=None, key: str = "pair_id",
            epoch: int = 0, num_partitions: int | None = None, encoder=None) -> DataFrame:
    """All rows with split, epoch order, batch and (for kept rows) the example arrays.

    The encoded rows come out of the regroup partitioned by ``key``; the slim
    rank table joins them on ``key``, so only the rank table is shuffled for
    that join.  Batches are cut before the length filter (B2) unless
    ``cfg.filter_first``; then only kept rows are ranked.
    """
    if encoder is not None:
        enc = encoder(pairs)
    else:
        vs, vt = vocabs if vocabs is not None else fit_vocabs(pairs, cfg, _train_rows(pairs, cfg, key, num_partitions))
        enc = encode_kept(pairs, vs, vt, cfg, key)
    ex = enc if encoder is None else build_examples(enc, cfg.seq_len, keep_dropped=True)
    if cfg.filter_first:
        sp = ordering.split_pairs(pairs.select(key), key=key, seed=cfg.seed, ratio=cfg.train_ratio,
                                  num_partitions=num_partitions)
        kept = ex.select(key, "kept").join(sp, key).where(F.col("kept")).drop("kept")
        od = ordering.shuffle(kept, key=key, seed=cfg.seed, epoch=epoch, by=["split"], num_partitions=num_partitions)
        ranks = ordering.assign_batches(od, "order", "split", cfg.batch_size, cfg.val_batch_size)
        ranks = sp.join(ranks.drop("split", "split_rank"), key, "left")
    else:
        ranks = rank_keys(pairs.select(key), cfg, key, epoch, num_partitions)
    return ex.join(ranks, key).withColumn("epoch", F.lit(int(epoch)))


def word_lengths(pairs: DataFrame, cfg: PrepConfig, key: str = "pair_id") -> DataFrame:
    """Token counts of the word tokenizer without encoding: one id per word."""
    d = pairs.select(key, n_words("src_text").cast("int").alias("src_len"), n_words("tgt_text").cast("int").alias("tgt_len"))
    return d.withColumn("drop_reason", drop_reason("src_len", "tgt_len", cfg.seq_len)).withColumn(
        "kept", F.col("drop_reason").isNull()
    )


def prep_report(pairs: DataFrame, cfg: PrepConfig = PrepConfig(), vocabs=None, key: str = "pair_id",
                num_partitions: int | None = None, encoder=None) -> DataFrame:
    """A4 over a pair table: one row per split."""
    if encoder is None and not cfg.filter_first:
        lens = word_lengths(pairs, cfg, key)
        prepared = lens.join(rank_keys(pairs.select(key), cfg, key, 0, num_partitions), key)
    else:
        prepared = prepare(pairs, cfg, vocabs, key, num_partitions=num_partitions, encoder=encoder)
    slim = prepared.select("split", "kept", "drop_reason", "src_len", "tgt_len", "batch_id")
    return aggregates.prep_report(slim)
