"""Vocabularies, encode/decode and BPE training against a sequential learner."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.config import UNK_ID
from tessera.operators import bpe, tokenizer

TEXT = [
    "low lower lowest newer newest wider widest",
    "the low tower is lower than the newer tower",
    "aaa aaaa aa banana bandana",
    "new news newest lowly slowly",
]


def sequential_bpe(word_freq: dict, n_merges: int):
    """Plain one-merge-at-a-time learner: adjacent pairs counted as they would
    merge (runs of one symbol without overlap), the largest count wins, ties by
    (left, right); merges apply left to right."""
    words = {tuple(w): f for w, f in word_freq.items()}
    merges = []
    for _ in range(n_merges):
        pc = Counter()
        for syms, f in words.items():
            taken = -1
            for i, (a, b) in enumerate(zip(syms, syms[1:])):
                if a != b or taken < i:
                    pc[(a, b)] += f
                    taken = i + 1 if a == b else taken
        if not pc:
            break
        best = min(pc.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        merges.append(best)
        nw = {}
        for syms, f in words.items():
            out, i = [], 0
            while i < len(syms):
                if i + 1 < len(syms) and (syms[i], syms[i + 1]) == best:
                    out.append(syms[i] + syms[i + 1])
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            nw[tuple(out)] = nw.get(tuple(out), 0) + f
        words = nw
    return merges


def test_bpe_matches_sequential_learner(spark):
    df = spark.createDataFrame([(t,) for t in TEXT], "text string")
    wf = Counter("▁" + w for t in TEXT for w in t.split())
    alphabet = {c for w in wf for c in w}
    n_merges = 25
    vocab, merges, rounds = bpe.train_bpe(df, "text", 7 + len(alphabet) + n_merges, max_candidates=64)
    got = [(r.left, r.right) for r in merges.orderBy("rank").collect()]
    assert got == sequential_bpe(dict(wf), n_merges)
    assert rounds <= n_merges
    assert vocab.count() == 7 + len(alphabet) + len({a + b for a, b in got})


def test_bpe_roundtrip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXT + ["", "ｔｈａｔ thing"])], "k bigint, text string")
    vocab, merges, _ = bpe.train_bpe(df, "text", 60)
    enc = bpe.encode(df, "k", "text", vocab, merges)
    dec = tokenizer.decode_ids(enc, "k", "ids", vocab, "decoded", mode="subword")
    got = {r.k: r.decoded for r in dec.collect()}
    assert got[0] == TEXT[0] and got[4] == "" and got[5] == "that thing"


def test_encode_word_replays_merges():
    ranks = {("a", "b"): 0, ("ab", "c"): 1}
    ids = {"a": 7, "b": 8, "c": 9, "ab": 10, "abc": 11}
    assert bpe.encode_word("abcab", ranks, ids) == [11, 10]
    assert bpe.encode_word("xz", ranks, ids) == [UNK_ID, UNK_ID]


def test_word_vocab_ids_and_unknowns(spark):
    df = spark.createDataFrame([(1, "b a a c c c"), (2, "d")], "pair_id bigint, text string")
    v = {r.piece: r.id for r in tokenizer.fit_word_vocab(df, "text", 9).collect()}
    assert v["c"] == 7 and v["a"] == 8 and "d" not in v and v["[PAD]"] == 3
    enc = {r.pair_id: r.ids for r in tokenizer.encode_words(df, "pair_id", [("text", "ids", tokenizer.fit_word_vocab(df, "text", 9))]).collect()}
    assert enc[1] == [UNK_ID, 8, 8, 7, 7, 7] and enc[2] == [UNK_ID]


def test_char_inventory_coverage(spark):
    wc = spark.createDataFrame([("aab", 10), ("c", 1)], "word string, freq bigint")
    full = {r.ch: r.freq for r in tokenizer.char_inventory(wc, 1.0).collect()}
    assert full == {"a": 20, "b": 10, "c": 1}
    part = {r.ch for r in tokenizer.char_inventory(wc, 0.9).collect()}
    assert part == {"a", "b"}


def test_pair_counts_round0(spark):
    words = spark.createDataFrame([(["▁", "a", "a", "a"], 2), (["a"] * 4 + ["b"] + ["a"] * 5, 1), (["."] * 2, 3), ([], 1), (["x"], 1)], "syms array<string>, freq bigint")
    got = {(r.left, r.right): r.n for r in bpe.pair_counts(words).collect()}
    assert got == {("▁", "a"): 2, ("a", "a"): 2 + 4, ("a", "b"): 1, ("b", "a"): 1, (".", "."): 3}  # runs count without overlap


def test_vocab_size_and_check(spark):
    from tessera.operators import checks

    df = spark.createDataFrame([(1, "x y z")], "pair_id bigint, text string")
    v = tokenizer.fit_word_vocab(df, "text", 100)
    assert tokenizer.vocab_size(v).collect()[0].vocab_size == 10
    enc = tokenizer.encode_words(df, "pair_id", [("text", "ids", v)])
    r = checks.check_vocab(enc, v, "ids").collect()[0]
    assert r.ids_in_range and r.specials_present
    assert F is not None


def test_nfkc_after_counting_equals_nfkc_first(spark):
    from tessera.functions.text import nfkc, split_words

    rows = [("ｔｈａｔ thing",), ("a¨b ｔｈａｔ",), ("plain words here",), (None,), ("",)]
    df = spark.createDataFrame(rows, "text string")
    got = {r.word: r.freq for r in tokenizer.word_counts(df, "text", apply_nfkc=True).collect()}
    first = df.select(F.explode(split_words(nfkc("text"))).alias("word")).groupBy("word").count()
    assert got == {r.word: r["count"] for r in first.collect()}
    assert got["that"] == 2 and "a" in got  # U+00A8 expands to a space plus a combining mark


def test_encode_raw_word_splits_after_nfkc():
    ranks, ids = {}, {"▁": 7, "a": 8}
    assert bpe.encode_raw_word("▁a¨", ranks, ids) == [7, 8, 7, 0]


def test_rowwise_encode_equals_join_encode(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXT + ["", None, "ｔｈａｔ a¨b"])], "k bigint, text string")
    vocab, merges, _ = bpe.train_bpe(df, "text", 60)
    a = {r.k: r.ids for r in bpe.encode(df, "k", "text", vocab, merges).collect()}
    b = {r.k: r.ids for r in bpe.encode(df, "k", "text", vocab, merges, strategy="rowwise").collect()}
    assert a == b and a[len(TEXT)] == [] and a[len(TEXT) + 1] is None


def test_rows_are_encoded_where_they_are(spark, monkeypatch):
    texts = [(1, "b a\u3000c"), (2, None), (3, ""), (None, "a b"), (5, "\u00e9 \U0001f600a\x1cb\u0085b"), (6, "a b"), (6, "c"), (6, None), (7, " c a [PAD] ")]
    df = spark.createDataFrame(texts, "k bigint, text string")
    words, letters = tokenizer.fit_word_vocab(df, "text", 10), tokenizer.fit_char_vocab(df, "text", 10)

    def all_of(rows):
        cases = (("word", words, False), ("char", letters, False), ("word", words, True))
        return [sorted(((r.k, r.text, r.ids) for r in tokenizer.encode_words(rows, "k", [("text", "ids", v)], unit=u, marked=m).collect()), key=str)
                for u, v, m in cases]

    got, alone = all_of(df), df.where("k <> 6")
    plan = tokenizer.encode_words(alone, "k", [("text", "ids", words)])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr(tokenizer, "MAX_ROWWISE_VOCAB", 3)
    assert got == all_of(df)
    assert got[0][0][2] is not None
