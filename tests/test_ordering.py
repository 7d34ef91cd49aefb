"""Exact ranks, splits, batches, steps, resume."""

from pyspark.sql import functions as F

from tessera.operators import ordering


def _ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "pair_id")


def test_split_sizes(spark):
    for n, train in ((1, 0), (9, 8), (10, 9), (233, 209)):
        sp = ordering.split_pairs(_ids(spark, n))
        got = {r.split: r.c for r in sp.groupBy("split").agg(F.count("*").alias("c")).collect()}
        assert got.get("train", 0) == train
        assert got.get("validation", 0) == n - train


def test_rank_is_exact_permutation_and_partition_independent(spark):
    n = 1000
    ranks = {}
    for parts in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        r = ordering.rank_by_hash(_ids(spark, n), "pair_id", "42", "rank")
        ranks[parts] = {x.pair_id: x.rank for x in r.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(ranks[1].values()) == list(range(n))
    assert ranks[1] == ranks[4] == ranks[64]
    import hashlib

    expect = sorted(range(n), key=lambda k: (hashlib.md5(f"{k}:42".encode()).hexdigest(), k))
    assert [ranks[1][k] for k in expect] == list(range(n))


def test_empty_batch_vanishes_and_steps_stay_dense(spark):
    # 24 rows in one epoch; ranks 8-15 (batch 1) are all too long
    rows = [(i, 0, i, i // 8, not (8 <= i < 16)) for i in range(24)]
    df = spark.createDataFrame(rows, "pair_id bigint, epoch int, order bigint, batch_id bigint, kept boolean")
    st = ordering.assign_steps(df, keep_col="kept").select("batch_id", "step").distinct().collect()
    assert sorted((r.batch_id, r.step) for r in st) == [(0, 0), (2, 1)]
    st2 = ordering.assign_steps(df, keep_col="kept", initial_step=100).select("step").distinct().collect()
    assert sorted(r.step for r in st2) == [100, 101]


def test_epoch_orders_differ_per_epoch(spark):
    eo = ordering.epoch_orders(_ids(spark, 50), [0, 1])
    e = {}
    for r in eo.collect():
        e.setdefault(r.epoch, {})[r.pair_id] = r.order
    assert sorted(e[0].values()) == list(range(50)) and sorted(e[1].values()) == list(range(50))
    assert e[0] != e[1]


def test_resume_point(spark):
    empty = spark.createDataFrame([], "epoch int, global_step bigint")
    r = ordering.resume_point(empty).collect()[0]
    assert (r.initial_epoch, r.initial_step) == (0, 0)
    one = spark.createDataFrame([(4, 1234)], "epoch int, global_step bigint")
    r = ordering.resume_point(one).collect()[0]
    assert (r.initial_epoch, r.initial_step) == (5, 1234)


def test_validation_sample_matches_hash_order(spark):
    import hashlib

    df = _ids(spark, 40).withColumn("kept", F.col("pair_id") % 3 != 0)
    got = ordering.validation_sample(df, [0, 500], n=2).collect()
    for step in (0, 500):
        pool = [k for k in range(40) if k % 3 != 0]
        best = sorted(pool, key=lambda k: (hashlib.md5(f"{k}:42:val:{step}".encode()).hexdigest(), k))[:2]
        mine = [r.pair_id for r in sorted((r for r in got if r.step == step), key=lambda r: r.sample_idx)]
        assert mine == best


def test_validation_sample_keeps_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c"), (3, "d")], "pair_id long, text string")
    for n in (1, 2, 3, 4):
        got = ordering.validation_sample(df, [0, 7], n=n, keep_col=None).collect()
        for step in (0, 7):
            mine = [r for r in got if r.step == step]
            assert sorted(r.sample_idx for r in mine) == list(range(n)) and len({r.text for r in mine}) == n


def test_balance_spreads_only_skinny_inputs(spark):
    from tessera.session import balance

    one = spark.range(100).coalesce(1)
    want = spark.sparkContext.defaultParallelism
    assert balance(one).rdd.getNumPartitions() == want
    many = spark.range(0, 100, 1, want * 2)
    assert balance(many).rdd.getNumPartitions() == want * 2
    assert sorted(r.id for r in balance(one).collect()) == list(range(100))
