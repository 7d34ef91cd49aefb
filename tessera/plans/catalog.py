"""The registered queries: one per operator of the survey inventory.

Every query reads the given tables (or fixtures Spark derives from them)
whole; results are shaped for an order-insensitive comparison with the
DuckDB statements in :mod:`tessera.plans.oracle` (arrays as comma-joined
text, floats rounded to 6 places, counts as BIGINT).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import EOS_ID, PrepConfig, SOS_ID
from tessera.functions import arrays as A
from tessera.functions import text as TX
from tessera.operators import aggregates, bpe, checks, examples, lookup, metrics, ordering, scoring, tokenizer, vectors
from tessera.plans import prep
from tessera.session import scratch_path
from tessera.sources import aligned, artifacts, translations
from tessera.sources import fixtures as fx

CFG = PrepConfig()
WORD_VOCAB = 2000  # word vocabulary per side for the example queries
SMALL_VOCAB = 500  # small enough that unknown words occur
BPE_VOCAB = 400
EPOCHS = list(range(CFG.num_epochs))


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---------------------------------------------------------------- shared pieces

def _conv_encoded(spark, d, vocab_size=WORD_VOCAB):
    cp = fx.conv_pairs(spark, d)
    vs = tokenizer.fit_word_vocab(cp, "src_text", vocab_size)
    vt = tokenizer.fit_word_vocab(cp, "tgt_text", vocab_size)
    return prep.encode_pairs(cp, vs, vt), vs, vt


def _conv_prepared(spark, d, cfg=CFG):
    cp = fx.conv_pairs(spark, d)
    vocabs = prep.fit_vocabs(cp, cfg.with_(vocab_size=WORD_VOCAB))
    return prep.prepare(cp, cfg, vocabs)


def _conv_examples(spark, d):
    cp = fx.conv_pairs(spark, d)
    vs, vt = prep.fit_vocabs(cp, CFG.with_(vocab_size=WORD_VOCAB))
    return prep.encode_kept(cp, vs, vt, CFG).where(F.col("kept"))


def _conv_bpe_prepared(spark, d):
    """The pairs prepared with a BPE model for each side, as the trainer encodes them."""
    cp = fx.conv_pairs(spark, d)
    models = [bpe.train_bpe(cp, c, BPE_VOCAB)[:2] for c in ("src_text", "tgt_text")]
    return prep.prepare(cp, CFG, encoder=prep.bpe_encoder(*models))


# ---------------------------------------------------------------- sources

def q_s1_aligned_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lp = fx.line_pairs(spark, d)
    base = scratch_path(spark, "aligned")
    aligned.write_hypotheses(lp, f"{base}/lines.src", order_col="pair_id", text_col="src_text")
    aligned.write_hypotheses(lp, f"{base}/lines.tgt", order_col="pair_id", text_col="tgt_text")
    return aligned.read_aligned_lines(spark, f"{base}/lines.src", f"{base}/lines.tgt")


def q_s2_read_translations(spark, d):
    path = scratch_path(spark, "nested")
    fx.translation_nested(spark, d).write.mode("overwrite").parquet(path)
    return translations.read_translations(spark, path, "en", "zh")


def q_s3_sentences(spark, d):
    return translations.sentences(fx.translation_nested(spark, d), "zh")


def q_s8_latest_artifact(spark, d):
    docs = fx.read_table(spark, d, "documents")
    paths = docs.select(F.concat(F.lit("/runs/"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pt")).alias("path"))
    paths = paths.unionByName(docs.select(F.concat(F.lit("/runs/"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pt.tmp")).alias("path")))
    return artifacts.latest_artifact(paths)


def q_s4_training_text(spark, d):
    path = scratch_path(spark, "train-text")
    artifacts.write_training_text(fx.read_table(spark, d, "documents"), "text", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def q_s5_vocab_roundtrip(spark, d):
    path = scratch_path(spark, "tokenizer_de")
    cp = fx.conv_pairs(spark, d)
    vocab, _ = artifacts.get_or_build_vocab(spark, path, lambda: (tokenizer.fit_word_vocab(cp, "src_text", SMALL_VOCAB), None))
    return vocab


def q_s6_write_examples(spark, d):
    path = scratch_path(spark, "examples")
    p = _conv_prepared(spark, d).where(F.col("kept"))
    artifacts.write_examples(p.select("split", "epoch", "batch_id", "order", "pair_id", "encoder_input"), path,
                             order_cols=("split", "epoch", "order"))
    back = spark.read.parquet(path)
    return back.select("split", "batch_id", "order", "pair_id", A.join_ints("encoder_input").alias("encoder_input"))


def q_s6_resume_examples(spark, d):
    """All epochs' examples in step order; read again from the step after the first half of the epochs."""
    path = scratch_path(spark, "stepped-examples")
    steps = _conv_steps(spark, d).select("split", "epoch", "step", "order", "pair_id", "encoder_input")
    artifacts.write_stepped_examples(steps, path)
    done = spark.read.parquet(path).where(F.col("epoch") < len(EPOCHS) // 2).agg(F.max("epoch").alias("epoch"), (F.max("step") + 1).alias("global_step"))
    rp = ordering.resume_point(done).first()
    rest = artifacts.resume_examples(spark, path, rp.initial_step)
    return rest.select("epoch", "step", "order", "pair_id", A.join_ints("encoder_input").alias("encoder_input"))


def q_s7_append_batches(spark, d):
    """Batches of a log appended twice each, as a retried job does."""
    path = scratch_path(spark, "scalar-batches")
    log = fx.scalar_log(spark, d)
    for _ in range(2):
        for batch, clicks in enumerate((F.col("tag") == "click", ~F.col("tag").eqNullSafe("click"))):
            artifacts.append_scalars(log.where(clicks), path, run="a", batch=batch)
    return artifacts.read_scalars(spark, path).select("tag", "step", "value")


def q_s7_append_scalars(spark, d):
    path = scratch_path(spark, "scalars")
    log = fx.scalar_log(spark, d)
    artifacts.append_scalars(log.where(F.col("tag") != "click"), path)
    artifacts.append_scalars(log.where(F.col("tag") == "click"), path)
    return spark.read.parquet(path).select("tag", "step", "value")


# ---------------------------------------------------------------- projections, filters, checks

def q_f1_flatten_struct(spark, d):
    cp = fx.conv_pairs(spark, d)
    nested = cp.select("pair_id", F.struct(F.col("src_text").alias("en"), F.col("tgt_text").alias("zh")).alias("translation"))
    return translations.flatten_pairs(nested, "en", "zh")


def q_f2_length_filter(spark, d):
    cp = fx.conv_pairs(spark, d)
    lens = cp.select("pair_id", TX.n_words("src_text").alias("src_len"), TX.n_words("tgt_text").alias("tgt_len"))
    return checks.length_filter(lens, CFG.seq_len, keep_dropped=True).select("pair_id", "src_len", "tgt_len", "drop_reason", "kept")


def q_f3_drop_empty(spark, d):
    p = _conv_prepared(spark, d)
    kept = checks.drop_empty(p, ["encoder_input"])
    return kept.groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.count_distinct("batch_id").cast("bigint").alias("n_batches")
    )


def q_f4_normalize_newlines(spark, d):
    return fx.read_table(spark, d, "documents").select("doc_id", TX.normalize_newlines("text").alias("text"))


def q_f5_check_shapes(spark, d):
    return checks.check_shapes(_conv_examples(spark, d), CFG.seq_len)


def q_q1_check_vocab(spark, d):
    cp = fx.conv_pairs(spark, d)
    v = tokenizer.fit_word_vocab(cp, "src_text", SMALL_VOCAB)
    enc = tokenizer.encode_words(cp, "pair_id", [("src_text", "ids", v)])
    return checks.check_vocab(enc, v, "ids")


def q_q2_literal_specials(spark, d):
    return checks.check_literal_specials(fx.read_table(spark, d, "documents"), ["text"])


# ---------------------------------------------------------------- tokenizer

def q_t1_normalize(spark, d):
    return fx.read_table(spark, d, "documents").select("doc_id", TX.normalize("text").alias("normalized"))


def q_t2_word_counts(spark, d):
    return tokenizer.word_counts(fx.read_table(spark, d, "documents"), "text").select("word", F.col("freq").cast("bigint"))


def q_t3_char_inventory(spark, d):
    wc = tokenizer.word_counts(fx.read_table(spark, d, "documents"), "text")
    return tokenizer.char_inventory(wc, 1.0)


def q_t4_pair_counts(spark, d):
    wc = tokenizer.word_counts(fx.read_table(spark, d, "documents"), "text", marked=True)
    return bpe.pair_counts(wc.select(bpe.symbols_of("word").alias("syms"), "freq"))


def q_t5_train_bpe(spark, d):
    cp = fx.conv_pairs(spark, d)
    _v, merges, _rounds = bpe.train_bpe(cp, "src_text", BPE_VOCAB)
    return merges


def q_t6_with_specials(spark, d):
    cp = fx.conv_pairs(spark, d)
    return tokenizer.fit_word_vocab(cp, "src_text", SMALL_VOCAB)


def q_t7_piece_to_id(spark, d):
    cp = fx.conv_pairs(spark, d)
    v = tokenizer.fit_word_vocab(cp, "src_text", SMALL_VOCAB)
    words = cp.select("pair_id", F.posexplode(TX.split_words("src_text")).alias("pos", "piece"))
    return tokenizer.piece_to_id(words, v, "piece", "id")


def q_t8_vocab_size(spark, d):
    cp = fx.conv_pairs(spark, d)
    return tokenizer.vocab_size(tokenizer.fit_word_vocab(cp, "src_text", SMALL_VOCAB))


def q_t9_bpe_roundtrip(spark, d):
    cp = fx.conv_pairs(spark, d)
    vocab, merges, _ = bpe.train_bpe(cp, "src_text", BPE_VOCAB)
    enc = bpe.encode(cp, "pair_id", "src_text", vocab, merges, out_col="ids")
    dec = tokenizer.decode_ids(enc, "pair_id", "ids", vocab, "decoded", mode="subword")
    expect = F.array_join(TX.split_words(TX.nfkc("src_text")), " ")
    return dec.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.sum((F.col("decoded") == expect).cast("int")).cast("bigint").alias("n_equal"),
    )


def q_t10_decode(spark, d):
    cp = fx.conv_pairs(spark, d)
    v = tokenizer.fit_word_vocab(cp, "src_text", None)
    enc = tokenizer.encode_words(cp, "pair_id", [("src_text", "ids", v)])
    return tokenizer.decode_ids(enc, "pair_id", "ids", v, "text").select("pair_id", "text")


def q_t11_encode(spark, d):
    enc, _, _ = _conv_encoded(spark, d)
    return enc.select("pair_id", A.join_ints("src_ids").alias("src_ids"), A.join_ints("tgt_ids").alias("tgt_ids"))


def q_t11_char_vocab(spark, d):
    return tokenizer.fit_char_vocab(fx.read_table(spark, d, "documents"), "text", 60)


def q_t11_char_encode(spark, d):
    docs = fx.read_table(spark, d, "documents")
    v = tokenizer.fit_char_vocab(docs, "text", 60)
    enc = tokenizer.encode_words(docs, "doc_id", [("text", "ids", v)], unit="char")
    return enc.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(A.join_ints("ids")).alias("ids_md5"))


# ---------------------------------------------------------------- examples

def q_e7_examples(spark, d):
    ex = _conv_examples(spark, d)
    return ex.select(
        "pair_id",
        "src_len",
        "tgt_len",
        A.join_ints("encoder_input").alias("encoder_input"),
        A.join_ints("decoder_input").alias("decoder_input"),
        A.join_ints("label").alias("label"),
        A.join_ints("encoder_mask").alias("encoder_mask"),
        "decoder_valid_len",
    )


def q_e7_bpe_examples(spark, d):
    ex = _conv_bpe_prepared(spark, d).where(F.col("kept"))
    return ex.select("pair_id", "src_len", "tgt_len", A.join_ints("encoder_input").alias("encoder_input"),
                     A.join_ints("decoder_input").alias("decoder_input"), A.join_ints("label").alias("label"), "decoder_valid_len")


def q_a4_bpe_report(spark, d):
    return aggregates.prep_report(_conv_bpe_prepared(spark, d).select("split", "kept", "drop_reason", "src_len", "tgt_len", "batch_id"))


def q_e5_causal_mask(spark, d):
    ex = _conv_examples(spark, d)
    m = A.causal_mask(F.col("decoder_valid_len"))
    return ex.select("pair_id", F.md5(F.array_join(F.transform(m, lambda r: A.join_ints(r, "")), "|")).alias("mask_md5"))


def q_e6_decoder_mask(spark, d):
    ex = _conv_examples(spark, d)
    m = A.decoder_mask("decoder_input")
    return ex.select(
        "pair_id",
        F.md5(F.array_join(F.transform(m, lambda r: A.join_ints(r, "")), "|")).alias("mask_md5"),
        F.aggregate(F.flatten(m), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_ones"),
    )


def q_e8_inference_source(spark, d):
    enc, _, _ = _conv_encoded(spark, d)
    return enc.select("pair_id", A.join_ints(A.inference_source("src_ids")).alias("source_ids"))


def q_e9_collate(spark, d):
    p = _conv_prepared(spark, d).where(F.col("kept"))
    c = examples.collate(p, ("split", "batch_id"), "order", fields=("pair_id",))
    return c.select("split", "batch_id", F.col("n_rows").cast("bigint"), A.join_ints("pair_id").alias("pair_ids"))


# ---------------------------------------------------------------- split, shuffle, batch

def q_d0_exact_rank(spark, d):
    lp = fx.line_pairs(spark, d)
    return ordering.rank_by_hash(lp, "pair_id", CFG.seed, "rank").select("pair_id", "rank")


def q_d1_split(spark, d):
    return ordering.split_pairs(fx.line_pairs(spark, d)).select("pair_id", "split")


def q_d2_shuffle(spark, d):
    sp = ordering.split_pairs(fx.line_pairs(spark, d))
    return ordering.epoch_orders(sp, [0, 1, 2], by=["split"]).select("epoch", "split", "pair_id", "order")


def q_d2_permuted_epochs(spark, d):
    """The order of every epoch of a run, from one rank."""
    return ordering.permuted_epochs(fx.line_pairs(spark, d), EPOCHS).select("epoch", "split", "pair_id", "order")


def q_d3_batches(spark, d):
    p = _conv_prepared(spark, d)
    return p.select("pair_id", "split", "order", "batch_id", "kept")


def _conv_steps(spark, d):
    cp = fx.conv_pairs(spark, d)
    enc = prep.encode_pairs(cp, *prep.fit_vocabs(cp, CFG.with_(vocab_size=WORD_VOCAB)))
    ex = examples.build_examples(enc, CFG.seq_len, keep_dropped=True)
    sp = ordering.split_pairs(ex).where(F.col("split") == "train")
    eo = ordering.epoch_orders(sp, EPOCHS, by=["split"])
    b = ordering.assign_batches(eo, "order", "split", CFG.batch_size, CFG.val_batch_size)
    return ordering.assign_steps(b, keep_col="kept")


def q_d4_steps(spark, d):
    return _conv_steps(spark, d).select("epoch", "batch_id", "step").distinct()


def q_d5_resume(spark, d):
    """Checkpoints exist for the first half of the epochs (one per epoch, named
    as the trainer names them); resume after the latest and count what is left."""
    steps = _conv_steps(spark, d)
    done = steps.where(F.col("epoch") < F.lit(len(EPOCHS) // 2)).groupBy("epoch").agg((F.max("step") + 1).alias("global_step"))
    arts = done.select(
        F.format_string("weights/%s%02d.pt", F.lit(CFG.model_basename), F.col("epoch")).alias("path"), "epoch", "global_step"
    )
    latest = artifacts.latest_artifact(arts.select("path"), base=CFG.model_basename)
    state = arts.join(latest.select("path"), "path")
    rp = ordering.resume_point(state).collect()[0]
    rest = ordering.skip_finished(steps, rp.initial_epoch)
    return rest.agg(
        F.lit(rp.initial_epoch).alias("initial_epoch"),
        F.lit(rp.initial_step).cast("bigint").alias("initial_step"),
        F.count_distinct("epoch", "batch_id").cast("bigint").alias("remaining_batches"),
        F.min("step").cast("bigint").alias("first_step"),
    )


def q_d6_validation_sample(spark, d):
    p = _conv_prepared(spark, d).where(F.col("split") == "validation")
    steps = [0, 500]
    return ordering.validation_sample(p, steps, n=CFG.n_examples).select("step", "sample_idx", "pair_id")


# ---------------------------------------------------------------- aggregates

def q_a1_max_lengths(spark, d):
    enc, _, _ = _conv_encoded(spark, d)
    return aggregates.max_lengths(enc.select(F.size("src_ids").alias("src_len"), F.size("tgt_ids").alias("tgt_len")))


def q_a2_dataset_size(spark, d):
    return aggregates.dataset_size(ordering.split_pairs(fx.line_pairs(spark, d)), ["split"])


def q_a3_batch_count(spark, d):
    p = _conv_prepared(spark, d)
    bs = F.when(F.col("split") == "train", F.lit(CFG.batch_size)).otherwise(F.lit(CFG.val_batch_size))
    return aggregates.batch_count(p, bs, by=["split"])


def q_a4_prep_report(spark, d):
    cp = fx.conv_pairs(spark, d)
    return prep.prep_report(cp, CFG.with_(vocab_size=WORD_VOCAB))


def q_a4_prep_report_lines(spark, d):
    lp = fx.line_pairs(spark, d)
    return prep.prep_report(lp, CFG.with_(vocab_size=WORD_VOCAB))


def q_a5_latest_scalar(spark, d):
    return aggregates.latest_scalar(fx.scalar_log(spark, d))


# ---------------------------------------------------------------- evaluation

def q_m1_cer(spark, d):
    return metrics.cer(fx.hyp_ref(spark, d), by=["lang"]).withColumn("cer", _r("cer"))


def q_m2_wer(spark, d):
    return metrics.wer(fx.hyp_ref(spark, d), by=["lang"]).withColumn("wer", _r("wer"))


def q_m3_bleu(spark, d):
    return metrics.bleu(fx.hyp_ref(spark, d), by=["lang"], id_col="id").withColumn("bleu", _r("bleu"))


def q_m4_corpus_bleu(spark, d):
    return metrics.corpus_bleu(fx.hyp_ref(spark, d), by=["lang"], id_col="id").withColumn("bleu", _r("bleu", 4))


def q_m5_eval_rows(spark, d):
    return metrics.eval_rows(fx.hyp_ref(spark, d), "ref", "ref", "hyp", key="id")


def q_m6_eval_steps(spark, d):
    return metrics.eval_steps(_conv_steps(spark, d).select("step").distinct(), "step", CFG.eval_every)


def q_m7_validation_scalars(spark, d):
    hr = fx.hyp_ref(spark, d).withColumn("step", F.shiftright(F.col("id"), 32))
    return metrics.validation_scalars(hr, "step", id_col="id").withColumn("value", _r("value"))


def q_m7_validation_scalars_last(spark, d):
    hr = fx.hyp_ref(spark, d).withColumn("step", F.shiftright(F.col("id"), 32))
    return metrics.validation_scalars(hr, "step", mode="last", order_col="id").withColumn("value", _r("value"))


# ---------------------------------------------------------------- scores and vectors

def q_x1_log_softmax(spark, d):
    return vectors.log_softmax(fx.score_rows(spark, d), ["seq_id"]).select("seq_id", "token_id", _r("log_prob").alias("log_prob"))


def q_x2_argmax(spark, d):
    return vectors.argmax(fx.score_rows(spark, d), ["seq_id"]).select("seq_id", "token_id", _r("score").alias("score"))


def q_x3_smoothed_nll(spark, d):
    lp = vectors.log_softmax(fx.score_rows(spark, d), ["seq_id"])
    labels = fx.score_labels(spark, d)
    out = vectors.smoothed_nll(lp, labels, ["seq_id"])
    return out.select(_r("loss").alias("loss"), "n_positions")


def q_x4_strip_specials(spark, d):
    ex = _conv_examples(spark, d)
    return ex.select("pair_id", A.join_ints(A.strip_specials("encoder_input")).alias("ids"))


def q_x5_apply_stop(spark, d):
    ex = _conv_examples(spark, d)
    gen = F.concat(F.array(F.lit(SOS_ID)), F.col("label"))
    return ex.select("pair_id", A.join_ints(A.apply_stop(gen, 64, EOS_ID)).alias("ids"))


def q_x6_embed(spark, d):
    cp = fx.conv_pairs(spark, d)
    v = tokenizer.fit_word_vocab(cp, "src_text", SMALL_VOCAB)
    enc = tokenizer.encode_words(cp, "pair_id", [("src_text", "ids", v)])
    e = vectors.embed(enc, fx.vectors(spark, d), "pair_id", "ids")
    return e.select(
        "pair_id",
        "pos",
        F.col("token_id").cast("bigint").alias("token_id"),
        _r(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)).alias("vec_sum"),
        _r(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 4).alias("vec_sq"),
    )


def _weighted(found):
    return found.select("query_id", F.posexplode("weighted").alias("k", "value")).withColumn("value", _r("value"))


def q_x7_softmax_lookup(spark, d):
    """Every 50th vector against all; the keys of one label are masked."""
    v = fx.vectors(spark, d).withColumn("kept", F.col("label") != 3)
    return _weighted(lookup.softmax_lookup(v.where("vec_id % 50 = 0"), v, mask="kept"))


def q_x7_softmax_lookup_blocks(spark, d):
    """Every vector against those of its label."""
    v = fx.vectors(spark, d)
    return _weighted(lookup.softmax_lookup(v, v, block="label"))


def q_x8_position_features(spark, d):
    cp = fx.conv_pairs(spark, d)
    pos = cp.select("pair_id", F.posexplode(TX.split_words("src_text")).alias("pos", "_w"))
    feats = pos.select("pair_id", "pos", F.posexplode(A.position_features("pos", 16)).alias("k", "value"))
    return feats.select("pair_id", "pos", "k", _r("value").alias("value"))


def q_x9_standardize(spark, d):
    v = fx.vectors(spark, d)
    return v.select("vec_id", F.posexplode(A.standardize("embedding")).alias("k", "value")).select(
        "vec_id", "k", _r("value").alias("value")
    )


# ---------------------------------------------------------------- batch scoring

def q_i1_batch_predict(spark, d):
    cp = fx.conv_pairs(spark, d).select("pair_id", F.col("src_text").alias("text"))
    return scoring.batch_predict(cp, scoring.reverse_words_factory).select("pair_id", "prediction", "status", "error")


def q_i1_bounded_predict(spark, d):
    """Requests against a model of ``seq_len`` positions, in batches of at most 4,096 padded tokens."""
    cp = fx.conv_pairs(spark, d).select("pair_id", F.col("src_text").alias("text"))
    out = scoring.batch_predict(cp, scoring.reverse_words_factory, length=scoring.word_tokens("text"), max_len=CFG.seq_len, token_budget=4096)
    return out.select("pair_id", "prediction", "status", "error")


def queries() -> dict:
    return {
        name[2:]: fn
        for name, fn in globals().items()
        if name.startswith("q_") and callable(fn)
    }
