"""Hand-made rows for the example builder, filters, masks and strip rules."""

from pyspark.sql import functions as F

from tessera.config import EOS_ID, PAD_ID, SOS_ID, tokenizer_path
from tessera.functions import arrays as A
from tessera.functions import text as TX
from tessera.operators import checks, examples, tokenizer


def _lens(spark, rows):
    return spark.createDataFrame(rows, "pair_id bigint, src_len int, tgt_len int")


def test_length_bounds_inclusive(spark):
    df = _lens(spark, [(1, 126, 10), (2, 127, 10), (3, 10, 127), (4, 10, 128), (5, 127, 128), (6, None, 3)])
    out = {r.pair_id: r.drop_reason for r in checks.length_filter(df, 128, keep_dropped=True).collect()}
    assert out == {1: None, 2: "src_long", 3: None, 4: "tgt_long", 5: "both", 6: "null_text"}
    kept = [r.pair_id for r in checks.length_filter(df, 128).collect()]
    assert sorted(kept) == [1, 3]


def test_empty_text_gives_empty_ids_and_padded_input(spark):
    df = spark.createDataFrame([(1, "", "x")], "pair_id bigint, src_text string, tgt_text string")
    v = tokenizer.fit_word_vocab(df, "tgt_text", 50)
    enc = tokenizer.encode_words(df, "pair_id", [("src_text", "src_ids", v), ("tgt_text", "tgt_ids", v)])
    ex = examples.build_examples(enc, 128).collect()[0]
    assert ex.src_len == 0
    assert ex.encoder_input == [SOS_ID, EOS_ID] + [PAD_ID] * 126
    assert ex.encoder_mask == [1, 1] + [0] * 126
    assert ex.decoder_input[:2] == [SOS_ID, 7] and len(ex.decoder_input) == 128
    assert ex.label[:2] == [7, EOS_ID] and ex.decoder_valid_len == 2


def test_label_is_decoder_input_shifted(spark):
    df = spark.createDataFrame([(1, "a b c", "d e f g")], "pair_id bigint, src_text string, tgt_text string")
    vs = tokenizer.fit_word_vocab(df, "src_text", 50)
    vt = tokenizer.fit_word_vocab(df, "tgt_text", 50)
    enc = tokenizer.encode_words(df, "pair_id", [("src_text", "src_ids", vs), ("tgt_text", "tgt_ids", vt)])
    ex = examples.build_examples(enc, 16).collect()[0]
    for i in range(ex.tgt_len):
        assert ex.label[i] == ex.decoder_input[i + 1]
    assert checks.check_shapes(examples.build_examples(enc, 16), 16).collect()[0].n_bad == 0


def test_null_text_dropped_with_reason(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a", None), (3, "a", "b")], "pair_id bigint, src_text string, tgt_text string")
    v = tokenizer.fit_word_vocab(df, "src_text", 20)
    enc = tokenizer.encode_words(df, "pair_id", [("src_text", "src_ids", v), ("tgt_text", "tgt_ids", v)])
    out = {r.pair_id: r.drop_reason for r in examples.build_examples(enc, 128, keep_dropped=True).collect()}
    assert out == {1: "null_text", 2: "null_text", 3: None}


def test_missing_language_key_is_null(spark):
    from tessera.sources.translations import flatten_pairs

    df = spark.createDataFrame([(1, {"en": "hi"})], "pair_id bigint, translation map<string,string>")
    r = flatten_pairs(df, "en", "zh").collect()[0]
    assert r.src_text == "hi" and r.tgt_text is None


def test_strip_specials_cases(spark):
    rows = [(1, [SOS_ID, 7, 8, EOS_ID, 9]), (2, [7, 8]), (3, [EOS_ID]), (4, [SOS_ID]), (5, [])]
    df = spark.createDataFrame(rows, "k int, ids array<int>")
    out = {r.k: r.s for r in df.select("k", A.strip_specials("ids").alias("s")).collect()}
    assert out == {1: [7, 8], 2: [7, 8], 3: [], 4: [], 5: []}


def test_apply_stop(spark):
    df = spark.createDataFrame([(1, [SOS_ID, 7, EOS_ID, 9]), (2, [SOS_ID, 7, 8, 9])], "k int, ids array<int>")
    got = {r.k: r.s for r in df.select("k", A.apply_stop("ids", 3).alias("s")).collect()}
    assert got == {1: [SOS_ID, 7, EOS_ID], 2: [SOS_ID, 7, 8]}
    edge = {r.k: r.s for r in df.select("k", A.apply_stop("ids", 1).alias("s")).collect()}
    assert edge == {1: [SOS_ID], 2: [SOS_ID]}


def test_causal_and_decoder_mask(spark):
    df = spark.createDataFrame([([SOS_ID, 7, PAD_ID],)], "d array<int>")
    r = df.select(A.causal_mask(F.lit(3)).alias("c"), A.decoder_mask("d").alias("m")).collect()[0]
    assert r.c == [[1, 0, 0], [1, 1, 0], [1, 1, 1]]
    assert r.m == [[1, 0, 0], [1, 1, 0], [1, 1, 0]]


def test_inference_source(spark):
    df = spark.createDataFrame([([7, 8],)], "ids array<int>")
    assert df.select(A.inference_source("ids").alias("s")).collect()[0].s == [7, 8, EOS_ID]


def test_literal_special_counted(spark):
    df = spark.createDataFrame([("a [EOS] b",), ("plain",)], "text string")
    assert checks.check_literal_specials(df, ["text"]).collect()[0].n_special_text == 1


def test_literal_special_keeps_special_id(spark):
    df = spark.createDataFrame([(1, "a [EOS] b")], "pair_id bigint, text string")
    v = tokenizer.fit_word_vocab(df, "text", 20)
    ids = tokenizer.encode_words(df, "pair_id", [("text", "ids", v)]).collect()[0].ids
    assert ids[1] == EOS_ID


def test_fullwidth_and_newline_normalisation(spark):
    df = spark.createDataFrame([("ｔｈａｔ",), ("a\nb",), ("  ",)], "t string")
    got = [r.n for r in df.select(TX.normalize("t").alias("n")).collect()]
    assert got == ["▁that", "▁a▁b", ""]
    nl = df.select(TX.normalize_newlines("t").alias("x")).collect()[1].x
    assert nl == "a b"


def test_newline_encodes_like_space(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "a b")], "pair_id bigint, text string")
    v = tokenizer.fit_word_vocab(df, "text", 20)
    out = {r.pair_id: r.ids for r in tokenizer.encode_words(df, "pair_id", [("text", "ids", v)]).collect()}
    assert out[1] == out[2]


def test_tokenizer_path_keeps_language():
    assert tokenizer_path("tokenizer_{0}.model", "de") == "tokenizer_de"
    assert tokenizer_path("/x/tokenizer_{0}.json", "el") == "/x/tokenizer_el"


def test_collate_orders_batch(spark):
    rows = [("train", 0, 2, 20, [1]), ("train", 0, 1, 10, [2]), ("train", 1, 0, 30, [3])]
    df = spark.createDataFrame(rows, "split string, batch_id bigint, order bigint, pair_id bigint, encoder_input array<int>")
    out = {r.batch_id: r.pair_id for r in examples.collate(df, ("split", "batch_id"), "order", ("pair_id",)).collect()}
    assert out == {0: [10, 20], 1: [30]}


def test_prepare_with_bpe_encoder(spark):
    from tessera.config import PrepConfig
    from tessera.operators import bpe
    from tessera.plans import prep

    rows = [(i, f"the lower tower {i % 7}", f"newest wider {i % 5} road") for i in range(30)]
    df = spark.createDataFrame(rows, "pair_id bigint, src_text string, tgt_text string")
    ms = bpe.train_bpe(df, "src_text", 40)[:2]
    mt = bpe.train_bpe(df, "tgt_text", 40)[:2]
    cfg = PrepConfig(seq_len=32, batch_size=4)
    out = prep.prepare(df, cfg, encoder=prep.bpe_encoder(ms, mt)).collect()
    assert len(out) == 30
    assert {r.split for r in out} == {"train", "validation"}
    assert sum(r.split == "train" for r in out) == 27
    for r in out:
        if r.kept:
            assert len(r.encoder_input) == 32 and r.encoder_input[0] == SOS_ID
            assert r.label[: r.tgt_len] == r.decoder_input[1 : r.tgt_len + 1]
    rep = {r.split: r for r in prep.prep_report(df, cfg, encoder=prep.bpe_encoder(ms, mt)).collect()}
    assert rep["train"].n_rows == 27 and rep["train"].n_batches == 7


def test_literal_pad_keeps_explicit_mask(spark):
    df = spark.createDataFrame([(1, "a", "x [PAD] y"), (2, "a", "x y")], "pair_id bigint, src_text string, tgt_text string")
    v = tokenizer.fit_word_vocab(df, "tgt_text", 20)
    enc = tokenizer.encode_words(df, "pair_id", [("src_text", "src_ids", v), ("tgt_text", "tgt_ids", v)])
    out = {r.pair_id: r for r in examples.build_examples(enc, 8).collect()}
    assert out[1].decoder_pad_mask == [1, 1, 0, 1, 0, 0, 0, 0]
    assert out[2].decoder_pad_mask is None and out[2].decoder_valid_len == 3


def test_check_shapes_strict_raises(spark):
    import pytest

    df = spark.createDataFrame([([1, 2], [1, 2], [1, 2]), ([1], [1, 2], [1, 2])], "encoder_input array<int>, decoder_input array<int>, label array<int>")
    assert checks.check_shapes(df, 2).collect()[0].n_bad == 1
    with pytest.raises(Exception, match="seq_len"):
        checks.check_shapes(df, 2, strict=True).collect()
