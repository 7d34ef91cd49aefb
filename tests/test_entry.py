"""The driver contract in __spark_entry__.py."""

import __spark_entry__ as E


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    first = df.schema
    rows = df.collect()
    assert len(rows) == 2 and {r.split for r in rows} == {"train", "validation"}
    assert E.entry(spark).schema == first


def test_every_oracle_has_a_query_and_names_are_plain():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    if E.llm_queries:  # the subpackage's own tests cover its queries
        for name in [*E.llm_queries.queries(), "pipeline"]:
            del qs[name]
            sql.pop(name, None)
    # examples with BPE models: tested against plain versions
    assert set(qs) - set(sql) == {"e7_bpe_examples", "a4_bpe_report"}
    for name in qs:
        assert name == name.lower() and not name.startswith("op")


def test_bpe_approximate_mode_runs(spark):
    from tessera.operators import bpe

    df = spark.createDataFrame([("low lower lowest newer newest wider widest",)] * 3, "text string")
    _v, merges_exact, r_exact = bpe.train_bpe(df, "text", 40)
    _v, merges_fast, r_fast = bpe.train_bpe(df, "text", 40, exact=False)
    assert merges_fast.count() == merges_exact.count()
    assert r_fast <= r_exact
