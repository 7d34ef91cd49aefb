"""The pair index, softmax lookup, epoch permutation, batch distances, resumable files, keyed appends, equi-depth ranks, bounded scoring."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_contracts import distance
from test_tokenizer import TEXT, sequential_bpe
from tessera.operators import bpe, bpe_index, lookup, metrics, ordering, scoring, sequences, tokenizer
from tessera.plans import catalog
from tessera.sources import artifacts
from tessera.sources import fixtures as fx
from tessera.streaming import stream_ops

SF = "/root/testdata/sf0.001"


# ---- T4, T5: pair index

def test_pairs_of_one_word_as_in_the_jvm(spark):
    rng = random.Random(0)
    words = [[rng.choice("ab.$\\") for _ in range(rng.randrange(9))] for _ in range(300)] + [["a"] * 7, ["ab", "a", "a", "ab", "ab"]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words) if w], "i int, syms string")
    for r in df.select("i", bpe_index.distinct_pairs("syms").alias("p")).collect():
        assert Counter(tuple(p.split(" ")) for p in r.p) == bpe_index.pairs_of(words[r.i])
    assert bpe_index.pairs_of(list("aaaa")) == {("a", "a"): 2} and bpe_index.pairs_of(list("aaabaa")) == {("a", "a"): 2, ("a", "b"): 1, ("b", "a"): 1}


@pytest.mark.parametrize("candidates, compact, flush", [(1024, 32, 32), (6, 2, 5), (40, 3, 1)])
def test_index_learns_as_one_merge_at_a_time(spark, candidates, compact, flush):
    rng = random.Random(candidates)
    words = Counter("▁" + "".join(rng.choice("abc" if rng.random() < 0.6 else "aaaaabcde") for _ in range(rng.randrange(1, 14))) for _ in range(400))
    n = 60
    df = spark.createDataFrame([(w, f, " ".join(w)) for w, f in words.items()], "word string, freq bigint, syms string")
    index = bpe_index.PairIndex(df, compact, flush)
    merges, rounds = bpe_index.learn(index, n, {c for w in words for c in w}, candidates)
    assert [m[:2] for m in merges] == sequential_bpe(dict(words), n)
    assert rounds < n
    # the counts after the merges are those of the words as they stand
    index.flush()
    syms = {w: list(w) for w in words}
    for left, right, _ in merges:
        syms = {w: bpe_index.merge_pair(s, left, right) for w, s in syms.items()}
    want = Counter()
    for w, s in syms.items():
        for p, k in bpe_index.pairs_of(s).items():
            want[p] += k * words[w]
    assert {(r.left, r.right): r.n for r in index.counts().collect()} == want
    before = index.postings().count()
    index.compact()
    assert {(r.left, r.right): r.n for r in index.counts().collect()} == want and index.postings().count() <= before


@pytest.mark.parametrize("candidates, flush", [(1024, 32), (6, 5)])
def test_word_table_learns_as_one_merge_at_a_time(spark, candidates, flush):
    rng = random.Random(candidates)
    letters = "ab|\x1c\U0001f600"
    words = Counter("\u2581" + "".join(rng.choice(letters if rng.random() < 0.6 else "aaaaab|.") for _ in range(rng.randrange(14))) for _ in range(400))
    df = spark.createDataFrame([(w, f, " ".join(w)) for w, f in words.items()], "word string, freq bigint, syms string")
    table = bpe_index.WordTable(df, flush)
    merges, _ = bpe_index.learn(table, 60, {c for w in words for c in w}, candidates)
    assert [m[:2] for m in merges] == sequential_bpe(dict(words), 60)
    syms = {w: list(w) for w in words}
    for left, right, _ in merges:
        syms = {w: bpe_index.merge_pair(s, left, right) for w, s in syms.items()}
    assert {r.word: r.syms for r in table.words().collect()} == {w: " ".join(s) for w, s in syms.items()}


def test_training_goes_on_with_the_pair_index(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in ("low lower lowest newer", "wider new newest widest", "slow slower slowest aaaa aaa")], "text string")
    whole = [tuple(r) for r in bpe.train_bpe(df, "text", 45)[1].collect()]
    monkeypatch.setattr(bpe, "TABLE_MERGES", 5)
    assert len(whole) > 10 and sorted(tuple(r) for r in bpe.train_bpe(df, "text", 45)[1].collect()) == sorted(whole)


def test_rounds_read_only_what_they_touch(spark):
    words = Counter(w for r in fx.conv_pairs(spark, SF).collect() for w in r.src_text.split())
    df = spark.createDataFrame([("▁" + w, f, " ".join("▁" + w)) for w, f in words.items()], "word string, freq bigint, syms string")
    index = bpe_index.PairIndex(df)
    touched = []
    holding = index.holding
    index.holding = lambda pairs: touched.append(holding(pairs).count()) or holding(pairs)
    merges, _ = bpe_index.learn(index, 150, {c for w in words for c in "▁" + w}, most=8)
    assert [m[:2] for m in merges] == sequential_bpe({"▁" + w: f for w, f in words.items()}, 150)
    assert sum(touched[-5:]) < sum(touched[:5]) / 2


# ---- T9: long words, models that are joined

def replayed(word, ranks, ids):
    syms, last = list(word), -1
    while True:
        best = min((r for p in zip(syms, syms[1:]) if (r := ranks.get(p, -1)) > last), default=None)
        if best is None:
            return [ids.get(s, 0) for s in syms]
        last = best
        syms = bpe_index.merge_pair(syms, *next(p for p, r in ranks.items() if r == best))


def test_heap_encoder_replays_merges_and_is_not_quadratic():
    rng = random.Random(1)
    for _ in range(200):
        symbols, ranks = list("abc"), {}
        for _ in range(12):
            p = (rng.choice(symbols), rng.choice(symbols))
            if p not in ranks:
                ranks[p] = len(ranks)
                symbols.append(p[0] + p[1])
        ids = {s: i + 7 for i, s in enumerate(dict.fromkeys(symbols))}
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(40)))
        assert bpe.encode_word(word, ranks, ids) == replayed(word, ranks, ids)
    ranks = {("a", "b"): 0, ("ab", "ab"): 1, ("abab", "abab"): 2}
    t = time.perf_counter()
    got = bpe.encode_word("ab" * 50_000, ranks, {"abababab": 9})
    assert got == [9] * 12_500 and time.perf_counter() - t < 5


def test_joined_model_gives_the_same_ids(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*TEXT, "", None, "ｔｈａｔ a¨b [EOS] x[SOS]y", "the the the", "zzz"])]
    df = spark.createDataFrame(rows, "k bigint, text string")
    vocab, merges, _ = bpe.train_bpe(df.where("k <> 8"), "text", 70)
    want = {r.k: r.ids for r in bpe.encode(df, "k", "text", vocab, merges).collect()}
    monkeypatch.setattr(tokenizer, "MAX_BROADCAST_VOCAB", 3)
    sent = []
    monkeypatch.setattr(bpe, "broadcast_model", lambda *a: sent.append(a))
    got = {r.k: r.ids for r in bpe.encode(df, "k", "text", vocab, merges).collect()}
    assert got == want and not sent and want[5] is None and want[4] == [] and 0 in want[8]


# ---- X7

def plain_lookup(q, keys, masked, values):
    s = np.array([m if m is not None else float(np.dot(q, k)) / math.sqrt(len(q)) for k, m in zip(keys, masked)])
    w = np.exp(s - s.max())
    return (w / w.sum()) @ np.array(values)


@pytest.mark.parametrize("tile", [1, 3, 1024])
def test_softmax_lookup_in_any_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(lookup, "FAN", 2)
    rng = np.random.default_rng(7)
    keys = [(i, rng.normal(size=4) * 5, rng.normal(size=2), bool(rng.random() < 0.7), ["a", "b", None, "masked"][i % 4]) for i in range(40)]
    keys = [(i, k, v, kept and b != "masked", b) for i, k, v, kept, b in keys]
    schema = "id long, vec array<double>, val array<double>, kept boolean, b string, query_id int"
    bad = [(90, None, [1.0, 1.0], True, "a", 0), (91, [1.0] * 4, [1.0, None], True, "a", 0), (92, [float("nan")] * 4, [1.0, 1.0], True, "a", 0)]
    kd = spark.createDataFrame([(i, k.tolist(), v.tolist(), None if kept and i % 3 else kept, b, 0) for i, k, v, kept, b in keys] + bad, schema)
    asks = [(i, rng.normal(size=4).tolist(), None, None, ["a", "b", None, "masked", "nobody"][i % 5], 0) for i in range(15)]
    qd = spark.createDataFrame([*asks, asks[0], (99, None, None, None, "a", 0)], schema)
    got = lookup.softmax_lookup(qd, kd, "id", "id", "vec", "val", "kept", "b", tile)
    rows = {r.query_id: r for r in got.collect()}
    assert len(rows) == 16 == got.count() and rows[99].weighted is None
    for i, q, _, _, b, _ in asks:
        own = [(k, v, None if kept else lookup.MASKED) for _, k, v, kept, kb in keys if kb == b]
        if not own:
            assert rows[i].weighted is None and rows[i].b == "nobody"
            continue
        assert np.allclose(rows[i].weighted, plain_lookup(q, [k for k, _, _ in own], [m for _, _, m in own], [v for _, v, _ in own]), atol=1e-9)
        if b == "masked":  # all masked: the plain mean
            assert np.allclose(rows[i].weighted, np.mean([v for _, v, _ in own], axis=0))
    every = lookup.softmax_lookup(qd.where("id < 3"), kd, "id", "id", "vec", tile=tile)
    ks = [k for _, k, _, _, _ in keys] + [np.ones(4)]  # 91 has a usable vector, which is its value here
    for r in every.collect():
        q = next(a[1] for a in asks if a[0] == r.query_id)
        assert np.allclose(r.weighted, plain_lookup(q, ks, [None] * len(ks), ks), atol=1e-9)


def test_softmax_lookup_of_empty_tables(spark):
    v = fx.vectors(spark, SF)
    assert lookup.softmax_lookup(v.limit(0), v).collect() == []
    assert {r.weighted for r in lookup.softmax_lookup(v.limit(3), v.limit(0)).collect()} == {None}


# ---- D2

def test_permutation_is_one():
    for n in [*range(1, 80), 1000, 4097]:
        for epoch in (0, 1):
            got = ordering.permute(np.arange(n), np.full(n, n), ordering.round_keys("42", epoch))
            assert sorted(got.tolist()) == list(range(n))
    big = 10**12
    got = ordering.permute(np.arange(0, big, big // 1000), np.full(1000, big), ordering.round_keys("s", 3))
    assert len(set(got.tolist())) == 1000 and 0.4 < got.mean() / big < 0.6 and (got < big).all()
    a, b = (ordering.permute(np.arange(1000), np.full(1000, 1000), ordering.round_keys("42", e)) for e in (0, 1))
    assert (a == b).mean() < 0.02 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.1


def test_epochs_add_no_exchange(spark):
    pairs = fx.line_pairs(spark, SF)

    def exchanges(df):
        return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))))

    one, many = (ordering.permuted_epochs(pairs, list(range(n))) for n in (1, 20))
    assert exchanges(one) == exchanges(many) > 0
    rows = many.collect()
    n = pairs.count()
    for split, size in (("train", int(0.9 * n)), ("validation", n - int(0.9 * n))):
        for e in (0, 19):
            assert sorted(r.order for r in rows if r.split == split and r.epoch == e) == list(range(size))


# ---- M1 to M4

def ragged(texts):
    return np.concatenate([np.asarray(t, np.int64) for t in texts]), sequences.offsets_of(np.array([len(t) for t in texts]))


@pytest.mark.parametrize("seed", range(6))
def test_batch_distances_and_ngrams(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(3):
        texts.append([rng.integers(0, rng.integers(1, 9), rng.integers(0, 200 if seed % 2 else 20)).tolist() for _ in range(20)])
    texts[1][:6] = [[x for x in t if rng.random() < 0.9] for t in texts[0][:6]]
    texts[1][6], texts[0][7], texts[1][8] = texts[0][6], [], []
    a, b, c = map(ragged, texts)
    for x, y, d in zip(texts[0], texts[1], sequences.distances(a, b)):
        assert d == distance(x, y) == sequences.edit_distance(np.array(x, np.int64), np.array(y, np.int64))
    for refs, lists in (([b], texts[1:2]), ([b, c], texts[1:])):
        clipped, total = sequences.ngram_matches(a, refs, 4)
        for i, x in enumerate(texts[0]):
            for n in range(1, 5):
                have = Counter(zip(*(x[k:] for k in range(n))))
                most = Counter()
                for r in lists:
                    most |= Counter(zip(*(r[i][k:] for k in range(n))))
                assert (clipped[i, n - 1], total[i, n - 1]) == ((have & most).total(), have.total())


def test_character_errors_beyond_the_bands(spark):
    rng = random.Random(5)
    rows = []
    for n, share in ((3000, 0.4), (2000, 0.99), (900, 0.01), (0, 0), (700, 0.5)):
        ref = "".join(rng.choice("abé😀 ") for _ in range(n))
        rows.append(("".join(ch for ch in ref if rng.random() > share) + ("x" * 300 if n == 900 else ""), ref))
    rows += [(None, "a" * 600), ("a" * 600, None), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, hyp string, ref string")
    got = {r.id: r.char_edits for r in metrics.cer(df, by=["id"]).collect()}
    assert got == {i: distance(h or "", r or "") for i, (h, r) in enumerate(rows)}


def test_corpus_scalars_equal_a_plain_version(spark):
    hr = fx.hyp_ref(spark, SF).withColumn("step", F.shiftright("id", 32))
    got = {(r.tag, r.step): r.value for r in metrics.validation_scalars(hr, "step", id_col="id").collect()}
    sums = {}
    for r in hr.collect():
        s = sums.setdefault(r.step, np.zeros(4, np.int64))
        s += [distance(r.hyp, r.ref) if len(r.ref) < 400 else 0, len(r.ref), distance(r.hyp.split(), r.ref.split()), len(r.ref.split())]
        if len(r.ref) >= 400:
            s[0] = -10**9  # too long for the plain version
    for step, (ce, cn, we, wn) in sums.items():
        assert (got["validation/wer", step] is None) == (wn == 0) and (wn == 0 or math.isclose(got["validation/wer", step], we / wn))
        assert ce < 0 or cn == 0 or math.isclose(got["validation/cer", step], ce / cn)


# ---- S6 + D5, S7

def test_resume_opens_only_what_is_left(spark, tmp_dir):
    rows = spark.range(1000).select(F.floor(F.col("id") / 10).alias("step"), F.col("id").alias("order"), F.lit("train").alias("split"), F.col("id").alias("pair_id"))
    rows = rows.union(rows.limit(20).withColumn("split", F.lit("validation")))
    path = f"{tmp_dir}/ex"
    artifacts.write_stepped_examples(rows, path, num_partitions=8)
    every = spark.read.parquet(path)
    assert every.count() == 1020 and "_steps" not in " ".join(every.inputFiles())
    for first, left in ((0, 1000), (77, 230), (99, 10), (100, 0)):
        rest = artifacts.resume_examples(spark, path, first)
        assert sorted(r.pair_id for r in rest.collect()) == list(range(1000 - left, 1000)) and set(rest.columns) == set(every.columns)
        if first:
            assert len(rest.inputFiles()) < len(every.inputFiles()) / 2 or left == 0
    artifacts.write_stepped_examples(rows.where("step < 5"), path, num_partitions=2)  # the old index does not outlive its files
    assert artifacts.resume_examples(spark, path, 3).count() == 20
    artifacts.write_examples(rows, path, order_cols=("split", "step"))
    with pytest.raises(FileNotFoundError):
        artifacts.resume_examples(spark, path, 3)


def test_a_repeated_append_changes_nothing(spark, tmp_dir):
    log = spark.createDataFrame([("loss", i, i / 2) for i in range(10)], "tag string, step bigint, value double")
    path = f"{tmp_dir}/log"
    for batch in (0, 1, 1, 0):
        artifacts.append_scalars(log.where(F.col("step") % 2 == batch), path, run="r 1/x", batch=batch)
    artifacts.append_scalars(log.limit(1), path, run="r2", batch=0)
    assert sorted(artifacts.read_scalars(spark, path, "r 1/x").collect()) == sorted(log.collect())
    assert artifacts.read_scalars(spark, path).count() == 11


def test_a_replayed_micro_batch_changes_nothing(spark, tmp_dir):
    log = spark.createDataFrame([("loss", i, i / 2) for i in range(10)], "tag string, step bigint, value double")
    log.write.parquet(f"{tmp_dir}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_dir}/in")
    for attempt in range(2):  # the second run has lost its checkpoint and gets batch 0 again
        q = stream.writeStream.foreachBatch(stream_ops.scalars_per_batch(f"{tmp_dir}/log", "run")).option(
            "checkpointLocation", f"{tmp_dir}/ck{attempt}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(artifacts.read_scalars(spark, f"{tmp_dir}/log").collect()) == sorted(log.collect())


# ---- T11

def test_ranks_of_a_skewed_vocabulary(spark):
    rng = random.Random(2)
    words = {f"xy{rng.randrange(10**9):09d}": 1 for _ in range(6000)} | {f"é{i}": 2 for i in range(50)} | {"xy": 1, "": 7, "top": 10**12}
    counts = spark.createDataFrame(list(words.items()), "word string, freq bigint").repartition(5)
    got = {r.piece: r.id for r in tokenizer.all_pieces(counts).collect()}
    order = sorted(words, key=lambda w: (-words[w], w.encode()))
    assert got == {w: 7 + i for i, w in enumerate(order)}
    keyed = counts.withColumn("_key", F.concat(F.unhex(F.lpad(F.hex((1 << 63) - 1 - F.col("freq")), 16, "0")), F.col("word").cast("binary")))
    sizes = sorted(r["count"] for r in tokenizer.depth_buckets(keyed, "_key").groupBy("_bucket").count().collect())
    assert len(sizes) > 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert tokenizer.all_pieces(counts.limit(0)).collect() == []


# ---- I1

def test_long_requests_do_not_reach_the_predictor(spark):
    class Recorder:
        """A predictor that fails when it sees more than it may."""

        def predict_batch(self, texts):
            if len(texts) * max(len(t.split()) + 1 for t in texts) > 40 and len(texts) > 1:
                raise RuntimeError("over the budget")
            if any(len(t.split()) + 1 > 12 for t in texts):
                raise RuntimeError("over-long row reached the predictor")
            return [t.upper() for t in texts]

    texts = ["w " * (i % 15) for i in range(60)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = scoring.batch_predict(df, Recorder, length=scoring.word_tokens("text"), max_len=12, token_budget=40)
    rows = got.collect()
    assert got.columns == ["id", "text", "prediction", "status", "error"] and [r.id for r in rows] == list(range(61))
    for r in rows[:60]:
        n = len(r.text.split()) + 1
        assert (r.status, r.error) == (("ok", None) if n <= 12 else ("error", f"ValueError: {n} tokens, at most 12"))
        assert r.prediction == (r.text.upper() if n <= 12 else None)
    assert rows[60].status == "error"
    assert scoring.token_batches([5, 1, 9, 2, 100], 10) == [[1, 3], [0], [2], [4]]
    with pytest.raises(ValueError, match="length"):
        scoring.batch_predict(df, Recorder, max_len=3)


def test_new_catalog_queries_read_given_tables(spark):
    assert {"x7_softmax_lookup", "d2_permuted_epochs", "s6_resume_examples", "s7_append_batches", "i1_bounded_predict"} <= set(catalog.queries())
