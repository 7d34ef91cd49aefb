"""Aligned files, writers, artifacts."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import aligned, artifacts


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_aligned_lines_blank_line_kept(spark, tmp_dir):
    _write(f"{tmp_dir}/train.en", ["a", "", "c"])
    _write(f"{tmp_dir}/train.zh", ["x", "", "z"])
    rows = aligned.read_aligned_lines(spark, f"{tmp_dir}/train.en", f"{tmp_dir}/train.zh", "train").orderBy("line_no").collect()
    assert [(r.line_no, r.src_text, r.tgt_text) for r in rows] == [(0, "a", "x"), (1, "", ""), (2, "c", "z")]


def test_aligned_lines_unequal_counts_fail(spark, tmp_dir):
    _write(f"{tmp_dir}/valid.en", ["a", "b", "c"])
    _write(f"{tmp_dir}/valid.zh", ["x", "y"])
    with pytest.raises(Exception, match="line counts differ"):
        aligned.read_aligned_lines(spark, f"{tmp_dir}/valid.en", f"{tmp_dir}/valid.zh").collect()


def test_split_files_and_multi_block_order(spark, tmp_dir):
    n = 20000
    _write(f"{tmp_dir}/train.en", [f"s{i}" for i in range(n)])
    _write(f"{tmp_dir}/train.zh", [f"t{i}" for i in range(n)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = aligned.read_split_files(spark, tmp_dir, "en", "zh")
        bad = df.where((F.col("src_text") != F.concat(F.lit("s"), F.col("line_no").cast("string")))
                       | (F.col("tgt_text") != F.concat(F.lit("t"), F.col("line_no").cast("string")))).count()
        assert df.count() == n and bad == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_hypotheses_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(i, f"h {i}\nx") for i in range(50)], "line_no bigint, hyp string")
    aligned.write_hypotheses(df, f"{tmp_dir}/hyp", num_partitions=4)
    back = aligned.read_numbered_lines(spark, f"{tmp_dir}/hyp").orderBy("line_no").collect()
    assert [r.text for r in back] == [f"h {i} x" for i in range(50)]


def test_latest_artifact_by_number(spark):
    paths = ["w/tmodel_2.pt", "w/tmodel_10.pt", "w/tmodel_x.pt", "w/other_99.pt", "w/tmodel_10.pt.tmp"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    r = artifacts.latest_artifact(df, base="tmodel_").collect()
    assert [(x.base, x.path, x.number) for x in r] == [("tmodel_", "w/tmodel_10.pt", 10)]
    allb = {x.base: x.path for x in artifacts.latest_artifact(df).collect()}
    assert allb == {"tmodel_": "w/tmodel_10.pt", "other_": "w/other_99.pt"}


def test_training_text_written_once(spark, tmp_dir):
    df = spark.createDataFrame([("a\nb",), ("c",)], "t string")
    assert artifacts.write_training_text(df, "t", f"{tmp_dir}/txt") is True
    assert artifacts.write_training_text(df, "t", f"{tmp_dir}/txt") is False
    assert sorted(r.value for r in spark.read.text(f"{tmp_dir}/txt").collect()) == ["a b", "c"]


def test_vocab_save_load_and_build_once(spark, tmp_dir):
    from tessera.operators import tokenizer

    df = spark.createDataFrame([("x y",)], "t string")
    calls = []

    def build():
        calls.append(1)
        return tokenizer.fit_word_vocab(df, "t", 20), None

    v1, m1 = artifacts.get_or_build_vocab(spark, f"{tmp_dir}/tok_de", build)
    v2, _ = artifacts.get_or_build_vocab(spark, f"{tmp_dir}/tok_de", build)
    assert len(calls) == 1 and v1.count() == v2.count() == 9 and m1 is None
    with pytest.raises(FileNotFoundError):
        artifacts.load_vocab(spark, f"{tmp_dir}/missing")


def test_examples_and_scalars_written(spark, tmp_dir):
    ex = spark.createDataFrame([("train", 0, 1, 0, [1]), ("validation", 0, 0, 0, [2])],
                               "split string, epoch int, step bigint, order bigint, encoder_input array<int>")
    artifacts.write_examples(ex, f"{tmp_dir}/ex", num_partitions=2)
    assert sorted(os.listdir(f"{tmp_dir}/ex"))[:2] in (["_SUCCESS", "split=train"], ["._SUCCESS.crc", "_SUCCESS"])
    assert spark.read.parquet(f"{tmp_dir}/ex").where("split = 'train'").count() == 1
    sc = spark.createDataFrame([("train/loss", 0, 1.5)], "tag string, step bigint, value double")
    artifacts.append_scalars(sc, f"{tmp_dir}/log")
    artifacts.append_scalars(sc, f"{tmp_dir}/log")
    assert spark.read.parquet(f"{tmp_dir}/log").count() == 2


def test_read_translations_json(spark, tmp_dir):
    import json

    from tessera.sources.translations import read_translations, sentences

    recs = [{"pair_id": 1, "translation": {"en": "hello", "zh": "你好"}}, {"pair_id": 2, "translation": {"en": "bye"}}]
    with open(f"{tmp_dir}/train.jsonl", "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(r, ensure_ascii=False) for r in recs) + "\n")
    df = read_translations(spark, f"{tmp_dir}/train.jsonl", "en", "zh", fmt="json")
    got = {r.pair_id: (r.src_text, r.tgt_text) for r in df.collect()}
    assert got == {1: ("hello", "你好"), 2: ("bye", None)}
    raw = spark.read.json(f"{tmp_dir}/train.jsonl")
    assert sorted((r.pair_id, r.text) for r in sentences(raw, "en").collect()) == [(1, "hello"), (2, "bye")]


def test_lines_of_many_blocks_are_numbered_without_a_shuffle_of_the_text(spark, tmp_dir):
    from tessera.sources import aligned

    lines = [f"line {i} " + "x" * (i % 37) for i in range(3000)] + [""]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, hyp string")
    aligned.write_hypotheses(df, f"{tmp_dir}/many", num_partitions=5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("4k", "64k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            back = aligned.read_numbered_lines(spark, f"{tmp_dir}/many")
            assert {r.line_no: r.text for r in back.collect()} == dict(enumerate(lines))
            plan = back._jdf.queryExecution().optimizedPlan().toString()
            assert "row_number" not in plan and plan.count("Window") == 1  # over the blocks only
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
