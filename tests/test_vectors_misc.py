"""Score operators, strip edge cases, empty inputs."""

import math

from pyspark.sql import functions as F

from tessera.config import EOS_ID, PrepConfig, SOS_ID
from tessera.functions import arrays as A
from tessera.operators import vectors
from tessera.plans import prep


def test_argmax_tie_takes_lowest_id(spark):
    df = spark.createDataFrame([(1, 5, 0.5), (1, 2, 0.5), (1, 9, 0.1), (2, 3, -1.0)], "seq_id bigint, token_id int, score double")
    got = {r.seq_id: r.token_id for r in vectors.argmax(df, ["seq_id"]).collect()}
    assert got == {1: 2, 2: 3}


def test_log_softmax_normalises(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(5)], "seq_id bigint, token_id int, score double")
    lp = vectors.log_softmax(df, ["seq_id"]).collect()
    assert abs(sum(math.exp(r.log_prob) for r in lp) - 1.0) < 1e-12


def test_smoothed_nll_ignores_pad(spark):
    lp = spark.createDataFrame([(1, 0, math.log(0.5)), (1, 1, math.log(0.5)), (2, 0, math.log(0.5)), (2, 1, math.log(0.5))],
                               "seq_id bigint, token_id int, log_prob double")
    labels = spark.createDataFrame([(1, 0), (2, 3)], "seq_id bigint, label int")
    r = vectors.smoothed_nll(lp, labels, ["seq_id"], eps=0.1).collect()[0]
    assert r.n_positions == 1 and abs(r.loss - math.log(2)) < 1e-12


def test_strip_repeated_eos(spark):
    df = spark.createDataFrame([([SOS_ID, 7, EOS_ID, 8, EOS_ID],), ([EOS_ID, 7],)], "ids array<int>")
    got = [r.s for r in df.select(A.strip_specials("ids").alias("s")).collect()]
    assert got == [[7], []]


def test_empty_corpus_report(spark):
    df = spark.createDataFrame([], "pair_id bigint, src_text string, tgt_text string")
    assert prep.prep_report(df, PrepConfig()).collect() == []


def test_position_features_values(spark):
    df = spark.createDataFrame([(3,)], "pos int")
    f = df.select(A.position_features("pos", 4).alias("f")).collect()[0].f
    expect = [math.sin(3), math.cos(3), math.sin(3 * 10000 ** (-2 / 4)), math.cos(3 * 10000 ** (-2 / 4))]
    assert all(abs(a - b) < 1e-12 for a, b in zip(f, expect))
    assert F is not None


def test_log_softmax_window_path_agrees(spark):
    rows = [(g, t, float((g * 7 + t * 3) % 11) - 5.0) for g in range(4) for t in range(9)]
    df = spark.createDataFrame(rows, "seq_id bigint, token_id int, score double")
    a = {(r.seq_id, r.token_id): r.log_prob for r in vectors.log_softmax(df, ["seq_id"]).collect()}
    b = {(r.seq_id, r.token_id): r.log_prob for r in vectors.log_softmax(df, ["seq_id"], small_groups=True).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_small_aggregates(spark):
    from tessera.operators import aggregates

    log = spark.createDataFrame([("loss", 1, 2.0), ("loss", 3, 1.0), ("loss", 2, 5.0), ("bleu", 0, 0.1)], "tag string, step bigint, value double")
    got = {r.tag: (r.last_step, r.last_value) for r in aggregates.latest_scalar(log).collect()}
    assert got == {"loss": (3, 1.0), "bleu": (0, 0.1)}
    rows = spark.createDataFrame([("train", 0, True, 3, 4), ("train", 0, False, 300, 4), ("train", 1, False, 1, 400)],
                                 "split string, batch_id bigint, kept boolean, src_len int, tgt_len int")
    bc = aggregates.batch_count(rows, F.lit(8), by=["split"]).collect()[0]
    assert (bc.n_batches, bc.n_batches_kept) == (1, 1)
    ml = aggregates.max_lengths(rows).collect()[0]
    assert (ml.max_src_len, ml.max_tgt_len) == (300, 400)
