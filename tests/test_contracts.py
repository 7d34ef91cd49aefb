"""Contracts that earlier versions broke, one small case each."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import split_words
from tessera.operators import bpe, metrics, ordering, scoring, tokenizer, vectors
from tessera.plans import catalog
from tessera.sources import aligned, artifacts
from tessera.sources import fixtures as fx
from tessera.streaming import queries as stream_queries

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_on_long_lines(spark):
    rng = random.Random(3)
    rows = []
    for n, edits in ((400, 5), (600, 90), (30, 30), (1200, 400)):
        ref = [f"w{rng.randrange(5000)}é😀" for _ in range(n)]
        hyp = list(ref)
        for _ in range(edits):
            k = rng.randrange(len(hyp))
            hyp[k:k + 1] = rng.choice([[], ["neu"], [hyp[k], "mehr"]]) or []
            hyp = hyp or ["x"]
        rows.append((" ".join(hyp), " ".join(ref)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, hyp string, ref string")
    got = {r.id: r for r in metrics.error_rates(df, by=["id"]).collect()}
    for i, (h, r) in enumerate(rows):
        assert got[i].word_edits == distance(h.split(), r.split()) and got[i].ref_words == len(r.split())
    short = df.where("id = 2").select("id", F.substring("hyp", 1, 60).alias("hyp"), F.substring("ref", 1, 60).alias("ref"))
    r = short.collect()[0]
    assert metrics.cer(short).collect()[0].char_edits == distance(r.hyp, r.ref)


def test_wer_on_document_lines(spark):
    hr = fx.hyp_ref(spark, SF)
    rows = hr.collect()
    assert max(len(r.ref) for r in rows) > 300 and min(len(r.ref) for r in rows) < 10
    want = {}
    for r in rows:
        e, n = want.get(r.lang, (0, 0))
        want[r.lang] = (e + distance(r.hyp.split(), r.ref.split()), n + len(r.ref.split()))
    got = {r.lang: (r.word_edits, r.ref_words) for r in metrics.wer(hr, by=["lang"]).collect()}
    assert got == want
    last = {}
    for r in rows:
        if r.id >> 32 not in last or last[r.id >> 32].id < r.id:
            last[r.id >> 32] = r
    scal = {r.step: r.value for r in catalog.q_m7_validation_scalars_last(spark, SF).collect() if r.tag == "validation/wer"}
    for step, r in last.items():
        n = len(r.ref.split())
        assert scal[step] == (None if n == 0 else pytest.approx(distance(r.hyp.split(), r.ref.split()) / n, abs=1e-6))


def test_bleu_null_groups_and_repeated_ids(spark):
    t = "the cat sat on the mat"
    df = spark.createDataFrame([(1, None, t, t), (1, None, t, t), (2, "a", t, t)], "id long, g string, hyp string, ref string")
    got = {r.g: (r.bleu, r.hyp_len) for r in metrics.bleu(df, by=["g"], id_col="id").collect()}
    assert got == {None: (pytest.approx(1.0), 12), "a": (pytest.approx(1.0), 6)}
    two = metrics.bleu(df.withColumn("r2", F.lit("the cat")), refs=["ref", "r2"]).collect()[0]
    assert two.bleu == pytest.approx(1.0) and two.ref_len == 18


def test_ranks_keep_null_keys(spark):
    df = spark.createDataFrame([(None, "x"), (1, "x"), (2, None)], "k long, g string")
    assert sorted(r["rank"] for r in ordering.rank_by_hash(df, "k", "s", "rank").collect()) == [0, 1, 2]
    got = ordering.rank_within(df, ["g"], "k", "s").collect()
    assert sorted((str(r.g), r["rank"]) for r in got) == [("None", 0), ("x", 0), ("x", 1)]


def test_validation_sample_is_the_head_of_the_order(spark):
    df = spark.createDataFrame([(i, True) for i in range(50)], "pair_id long, kept boolean")
    got = ordering.validation_sample(df, [0, 5], n=3).collect()
    h = {(r.step, r.pair_id): r.h for r in df.crossJoin(spark.createDataFrame([(0,), (5,)], "step int")).select(
        "step", "pair_id", F.md5(F.concat(F.col("pair_id").cast("string"), F.lit(":42:val:"), F.col("step").cast("string"))).alias("h")).collect()}
    for step in (0, 5):
        want = sorted((v, p) for (s, p), v in h.items() if s == step)[:3]
        assert [(r.sample_idx, r.pair_id) for r in sorted(got, key=lambda r: r.sample_idx) if r.step == step] == [(i, p) for i, (_, p) in enumerate(want)]


def test_resume_point_is_one_artifact(spark):
    df = spark.createDataFrame([(0, 900), (1, 500)], "epoch int, global_step long")
    r = ordering.resume_point(df).collect()[0]
    assert (r.initial_epoch, r.initial_step) == (1, 900)


def test_latest_artifact_with_a_base_that_ends_in_a_digit(spark):
    names = ["r/v29.pt", "r/v210.pt", "r/v2.pt", "r/w3.pt", "r/v2" + "9" * 45 + ".pt", "r/v28.pt.tmp"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = artifacts.latest_artifact(df.where("length(path) < 20"), base="v2").collect()
    assert [(r.path, r.number) for r in got] == [("r/v210.pt", 10)]
    got = artifacts.latest_artifact(df, base="v2").collect()
    assert [(len(r.path), r.number) for r in got] == [(len(names[4]), None)]


def test_half_written_vocabulary_is_absent(spark, tmp_dir):
    import os

    v = spark.createDataFrame([("a", 7, 1, "word")], tokenizer.VOCAB_SCHEMA)
    m = spark.createDataFrame([(0, "a", "b")], "rank int, left string, right string")
    os.makedirs(f"{tmp_dir}/t/vocab")
    with pytest.raises(FileNotFoundError):
        artifacts.load_vocab(spark, f"{tmp_dir}/t")
    vocab, merges = artifacts.get_or_build_vocab(spark, f"{tmp_dir}/t", lambda: (v, m))
    assert vocab.count() == 1 and merges.count() == 1


def test_carriage_returns_keep_line_numbers(spark, tmp_dir):
    df = spark.createDataFrame([(0, "a\rb"), (1, "c\r\nd")], "line_no long, hyp string")
    aligned.write_hypotheses(df, f"{tmp_dir}/h")
    assert aligned.read_numbered_lines(spark, f"{tmp_dir}/h").count() == 2
    for name, lines in (("train.en", "a\rx\nb\n"), ("train.zh", "1\n2\n"), ("valid.en", "c\n"), ("valid.zh", "3\n")):
        open(f"{tmp_dir}/{name}", "w", newline="").write(lines)
    rows = aligned.read_split_files(spark, tmp_dir, "en", "zh").collect()
    assert len({r.pair_id for r in rows}) == len(rows) == 3
    assert {(r.split, r.line_no, r.tgt_text) for r in rows} == {("train", 0, "1"), ("train", 1, "2"), ("valid", 0, "3")}


def test_predictor_faults_are_row_errors(spark):
    class Short:
        def predict_batch(self, texts):
            return ["x"]

        def __call__(self, text):
            return 5 if text == "bad" else text.upper()

    df = spark.createDataFrame([("a",), ("bad",)], "text string").coalesce(1)
    got = {r.text: (r.prediction, r.status) for r in scoring.batch_predict(df, Short).collect()}
    assert got == {"a": ("A", "ok"), "bad": (None, "error")}


def test_vocabulary_smaller_than_the_alphabet(spark):
    with pytest.raises(ValueError, match="alphabet"):
        bpe.train_bpe(spark.createDataFrame([("low lower newest",)], "text string"), "text", 10)


def test_vocabulary_of_all_words(spark):
    df = spark.createDataFrame([("b a b c",), ("c b d",)], "text string")
    got = [(r.piece, r.id) for r in tokenizer.fit_word_vocab(df, "text", None).orderBy("id").collect()][7:]
    assert got == [("b", 7), ("c", 8), ("a", 9), ("d", 10)]


def test_lookup_of_an_absent_id(spark):
    ids = spark.createDataFrame([(1, [0, 9])], "k long, ids array<int>")
    table = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no vector for id 9"):
        vectors.embed(ids, table, "k").collect()
    assert vectors.embed(ids, table, "k", missing="null").count() == 2


def test_log_softmax_of_one_group(spark):
    df = spark.range(500).select(F.lit(1).alias("g"), F.col("id").alias("token_id"), (F.col("id") % 7 * 1.5).alias("score"))
    total = vectors.log_softmax(df, ["g"]).agg(F.sum(F.exp("log_prob"))).first()[0]
    assert total == pytest.approx(1.0)


def test_events_as_a_folder_of_part_files(spark, tmp_dir):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{tmp_dir}/events.parquet")
    one, many = stream_queries.q_st1_stream_scalars(spark, SF).count(), stream_queries.q_st1_stream_scalars(spark, tmp_dir).count()
    assert many == one > 0


def test_row_keys_do_not_collide(spark):
    df = spark.createDataFrame([(1, 1000), (2, 0), (1, 100000)], "a long, b int")
    assert df.select(fx.row_key("a", "b")).distinct().count() == 3
    assert split_words is not None


def test_literal_specials_in_subword_text(spark):
    df = spark.createDataFrame([(1, "low [EOS] lower x[PAD]y lowest"), (2, "newest [EOS]")], "k long, text string")
    vocab, merges, _ = bpe.train_bpe(df, "text", 24)
    ids = {r.piece: r.id for r in vocab.collect()}
    assert not any("[" in p or "E" in p for p in ids if ids[p] > 6)
    for strategy in ("rowwise", "join"):
        enc = bpe.encode(df, "k", "text", vocab, merges, strategy=strategy)
        got = {r.k: r.ids for r in enc.collect()}
        assert got[1].count(6) == 1 and got[1].count(3) == 1 and got[2][-1] == 6
        dec = {r.k: r.text2 for r in tokenizer.decode_ids(enc, "k", "ids", vocab, "text2", mode="subword").collect()}
        assert dec == {r.k: r.text for r in df.collect()}


def test_bpe_examples_equal_a_plain_encoder(spark):
    cp = fx.conv_pairs(spark, SF)
    models = []
    for c in ("src_text", "tgt_text"):
        vocab, merges, _ = bpe.train_bpe(cp, c, catalog.BPE_VOCAB)
        models.append(({(r.left, r.right): r["rank"] for r in merges.collect()}, {r.piece: r.id for r in vocab.collect()}))
    want = {}
    for r in cp.collect():
        s, t = ([i for w in x.split() for i in bpe.encode_raw_word("\u2581" + w, *m)] for x, m in zip((r.src_text, r.tgt_text), models))
        if len(s) <= 126 and len(t) <= 127:
            want[r.pair_id] = (len(s), len(t), ",".join(map(str, [5, *s, 6] + [3] * (126 - len(s)))))
    got = {r.pair_id: (r.src_len, r.tgt_len, r.encoder_input) for r in catalog.q_e7_bpe_examples(spark, SF).collect()}
    assert got == want
    report = catalog.q_a4_bpe_report(spark, SF).collect()
    assert {r.split for r in report} == {"train", "validation"}


def test_vocabulary_of_the_train_rows(spark):
    from tessera.config import PrepConfig
    from tessera.operators import ordering as o
    from tessera.plans import prep

    pairs = spark.createDataFrame([(i, f"word{i}", f"wort{i}") for i in range(40)], "pair_id long, src_text string, tgt_text string")
    cfg = PrepConfig(fit_on="train")
    out = prep.prepare(pairs, cfg)
    train = {r.pair_id for r in o.split_pairs(pairs.select("pair_id"), seed=cfg.seed, ratio=cfg.train_ratio).where("split = 'train'").collect()}
    for r in out.collect():
        assert (r.encoder_input[1] != 0) == (r.pair_id in train)


def test_strict_vocabulary_check(spark):
    from tessera.operators import checks

    df = spark.createDataFrame([(1, "a b")], "k long, text string")
    v = tokenizer.fit_word_vocab(df, "text", None)
    ids = spark.createDataFrame([(1, [7, 8])], "k long, ids array<int>")
    assert checks.check_vocab(ids, v, strict=True).collect()[0].specials_present
    with pytest.raises(Exception, match="lacks a special piece"):
        checks.check_vocab(ids, v.where("piece <> '[EOS]'"), strict=True).collect()
