"""CER, WER, BLEU on hand-made pairs."""

import math

from tessera.operators import metrics


def _df(spark, rows):
    return spark.createDataFrame(rows, "id bigint, hyp string, ref string")


def test_cjk_character_edit(spark):
    r = metrics.cer(_df(spark, [(1, "今天天气好", "今天天气很好")])).collect()[0]
    assert r.char_edits == 1 and r.ref_chars == 6


def test_identity_scores(spark):
    df = _df(spark, [(1, "the cat sat on the mat", "the cat sat on the mat")])
    assert metrics.cer(df).collect()[0].cer == 0.0
    assert metrics.wer(df).collect()[0].wer == 0.0
    assert abs(metrics.bleu(df, id_col="id").collect()[0].bleu - 1.0) < 1e-12


def test_wer_counts_word_edits(spark):
    r = metrics.wer(_df(spark, [(1, "a x c d", "a b c")])).collect()[0]
    assert (r.word_edits, r.ref_words) == (2, 3)


def test_empty_hypothesis_and_reference(spark):
    df = _df(spark, [(1, "", "a b c d"), (2, "a b", "")])
    b = metrics.bleu(df, id_col="id").collect()[0]
    assert b.bleu == 0.0
    c = metrics.cer(df).collect()[0]
    assert c.char_edits == 7 + 3 and c.ref_chars == 7


def test_empty_corpus_gives_null(spark):
    df = _df(spark, [])
    assert metrics.cer(df).collect()[0].cer is None


def test_bleu_matches_hand_computation(spark):
    df = _df(spark, [(1, "the cat is on the mat", "the cat sat on the mat")])
    r = metrics.bleu(df, id_col="id").collect()[0]
    p = [5 / 6, 3 / 5, 1 / 4, 0 / 3]
    assert (r.c1, r.c2, r.c3, r.c4) == (5, 3, 1, 0)
    assert r.bleu == 0.0  # no 4-gram match, no smoothing
    df2 = _df(spark, [(1, "the cat sat on the mat today", "the cat sat on the mat")])
    r2 = metrics.bleu(df2, id_col="id").collect()[0]
    p = [6 / 7, 5 / 6, 4 / 5, 3 / 4]
    expect = math.exp(sum(math.log(x) for x in p) / 4)
    assert abs(r2.bleu - expect) < 1e-12


def test_sacre_bleu_smoothing(spark):
    df = _df(spark, [(1, "the cat is on the mat", "the cat sat on the mat")])
    r = metrics.corpus_bleu(df, id_col="id").collect()[0]
    p = [100 * 5 / 6, 100 * 3 / 5, 100 * 1 / 4, 100 / (2 * 3)]
    expect = math.exp(sum(math.log(x) for x in p) / 4)
    assert abs(r.bleu - expect) < 1e-9


def test_13a_tokenizer(spark):
    from tessera.functions.text import tokenize_13a

    df = spark.createDataFrame([("Hello, world. It's 3.5-4 &amp; done!",)], "t string")
    got = df.select(tokenize_13a("t").alias("x")).collect()[0].x
    assert got == "Hello , world . It's 3.5 - 4 & done !"


def test_validation_scalars_last_mode(spark):
    rows = [(1, 0, "a b c d", "a b c d"), (2, 0, "x", "a b c d")]
    df = spark.createDataFrame(rows, "id bigint, step bigint, hyp string, ref string")
    last = {r.tag: r.value for r in metrics.validation_scalars(df, "step", mode="last", order_col="id").collect()}
    assert last["validation/wer"] == 1.0
    corpus = {r.tag: r.value for r in metrics.validation_scalars(df, "step", id_col="id").collect()}
    assert corpus["validation/wer"] == 4 / 8


def test_bleu_keeps_groups_without_ngrams(spark):
    rows = [(1, "a", "a b c d", "a b c d"), (2, "b", "", "")]
    df = spark.createDataFrame(rows, "id bigint, g string, hyp string, ref string")
    out = {r.g: (r.bleu, r.hyp_len) for r in metrics.bleu(df, by=["g"], id_col="id").collect()}
    assert out == {"a": (1.0, 4), "b": (0.0, 0)}


def test_error_rates_one_pass_matches_separate(spark):
    df = _df(spark, [(1, "a x c d", "a b c"), (2, "héllo wörld", "hallo world")])
    both = metrics.error_rates(df).collect()[0]
    assert both.char_edits == metrics.cer(df).collect()[0].char_edits
    assert both.word_edits == metrics.wer(df).collect()[0].word_edits


def test_word_distances_do_not_depend_on_the_cuts_of_a_batch(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    from tessera.operators.sequences import coded, distances

    rng = random.Random(3)
    rows = [(rng.choices("abcdefgh", k=rng.randrange(12)), rng.choices("abcdefgh", k=rng.randrange(12))) for _ in range(80)]
    rows += [([], list("abcdef")), ([f"w{i}" for i in range(500)], [f"w{i}" for i in range(3, 520) if i % 50])]
    h, r = (pa.array([x[k] for x in rows], pa.list_(pa.string())) for k in (0, 1))
    want = distances(*coded(h, r)).tolist()
    monkeypatch.setattr(metrics, "BATCH_WORDS", 4)
    groups = list(metrics._word_groups(h, r))
    assert len(groups) > 20 and np.concatenate([distances(*coded(*g)) for g in groups]).tolist() == want


def _plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_long_pairs_are_measured_side_by_side_and_exactly(monkeypatch):
    import random

    import numpy as np

    from tessera.operators import sequences as S

    rng, pairs = random.Random(5), []
    for n, edits, letters in [(70, 3, 4), (90, 50, 2), (300, 25, 30), (300, 90, 30), (400, 150, 3), (200, 140, 500), (130, 0, 9), (0, 4, 9)] * 6:
        x = [rng.randrange(letters) for _ in range(n)]
        y = list(x)
        for _ in range(edits):
            at = rng.randrange(len(y) + 1)
            y[at:at + rng.randrange(2)] = [rng.randrange(letters)] * rng.randrange(2)
        pairs.append((x, y) if rng.random() < 0.5 else (y, x))

    def ragged(texts):
        return np.array([c for t in texts for c in t], np.int64), S.offsets_of(np.array([len(t) for t in texts]))

    want = [_plain_distance(x, y) for x, y in pairs]
    slow = []
    monkeypatch.setattr(S, "edit_distance", lambda a, b, one=S.edit_distance: slow.append(len(a)) or one(a, b))
    sides = [ragged([x for x, _ in pairs]), ragged([y for _, y in pairs])]
    assert S.distances(*sides).tolist() == want
    monkeypatch.setattr(S, "FEW", 0)
    slow.clear()
    assert S.distances(*sides).tolist() == want
    assert len(slow) <= len(pairs) // 4  # the rest of the long pairs went side by side
    for name, value in (("TABLE", 1), ("STEP_SYMBOLS", 300), ("EDITS", 5), ("PAIRS", 4)):
        monkeypatch.setattr(S, name, value)
        assert S.distances(*sides).tolist() == want, name


def test_validation_scalars_are_those_of_the_metrics(spark):
    rows = [(1, "a b c d e", "a b x d e"), (1, None, "q"), (2, "\u5929 \U0001f600 z", "\u5929 z"), (None, "n m", None), (None, "k l m n o", "k l m n o")]
    df = spark.createDataFrame(rows, "step int, hyp string, ref string")
    got = {(r.tag, r.step): r.value for r in metrics.validation_scalars(df).collect()}
    for name, table in (("cer", metrics.cer(df, by=["step"])), ("wer", metrics.wer(df, by=["step"])), ("bleu", metrics.bleu(df, by=["step"]))):
        for r in table.collect():
            assert got.pop((f"validation/{name}", r.step)) == r[name]
    assert not got
