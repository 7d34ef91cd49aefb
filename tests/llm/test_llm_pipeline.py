"""Pipeline stages against plain versions of what they decide."""

import numpy as np
import pytest
from test_llm_joins import brute_components, brute_ranges, words_of

import corpus_pipeline as P
from tessera.llm import mixing
from tessera.llm.shared import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    """Nulls, repeats, extra columns with clashing names."""
    rng = np.random.default_rng(1)
    base = " ".join(f"the word{rng.integers(10**6)} of and that" for _ in range(30))
    other = " ".join(f"is it word{rng.integers(10**6)} in the house" for _ in range(30))
    data = [(1, base, "en", "a"), (1, base, "en", "a"), (2, base + " more", "en", None), (3, other, None, "a"), (3, "zzz " + other, "en", "a"),
            (4, None, "en", "b"), (5, "", "en", "b"), (6, "12 34", "en", "b"), (None, base, "en", None), (None, base, "en", None), (7, other + " " + base, "en", "b")]
    rows = [(i, t, lang, s, len(t or ""), 1, "k", 2.5) for i, t, lang, s in data]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int, component_id string, score double")


def test_stages_on_documents(spark, docs):
    a = stored(P.identified(spark, docs, SF))
    assert a.columns == docs.columns and a.count() >= 0.99 * docs.count()
    rows = {r.doc_id: r for r in a.collect()}
    b = stored(P.one_of_each_group(spark, a, SF))
    keep = {d for d, _, c in brute_components([(i, r.text) for i, r in rows.items()]) if d == c}
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == sorted(keep)
    c = stored(P.without_repeats(spark, b, SF))
    ranges = brute_ranges([(i, rows[i].text) for i in keep], 50)
    got = {r.doc_id: r for r in c.collect()}
    assert c.columns == docs.columns and got.keys() == keep
    for i in keep:
        w = words_of(rows[i].text, lower=False)
        gone = {k for lo, hi in ranges.get(i, ([], []))[1] for k in range(lo, hi)}
        assert words_of(got[i].text, lower=False) == [x for k, x in enumerate(w) if k not in gone]
        assert gone or got[i] == rows[i]
        assert got[i].n_chars == len(got[i].text)
    d = stored(P.mixed(spark, c, SF))
    want = {r.doc_id: r.copies for r in mixing.mix(c).collect() if r.copies}
    count = {}
    for r in d.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        assert r == got[r.doc_id]
    assert d.columns == docs.columns and count == want
    e = P.encoded(spark, d, SF).collect()
    assert len(e) == d.count() and all(len(r.ids) == r.n_tokens for r in e)


def test_run_is_repeatable(spark):
    one, two = (sorted(map(str, P.run(spark, SF).collect())) for _ in range(2))
    assert one == two and one


def test_stages_on_odd_rows(spark):
    df = odd(spark)
    for _, stage in P.STAGES:
        assert stage(spark, df.limit(0), SF).collect() == []
    a = P.identified(spark, df, SF)
    assert a.columns == df.columns and {r.doc_id for r in a.collect()} == {1, 2, 3, 7, None}
    texts = {(r.doc_id, r.text) for r in df.collect()}
    b = P.one_of_each_group(spark, df, SF)
    assert b.columns == df.columns
    kept = sorted((r.doc_id, r.text) for r in b.where("text IS NOT NULL").collect())
    one = {i: t for i, t in texts if i in (1, 7)}
    three = sorted(t for i, t in texts if i == 3)
    # both texts of id 3 are near copies of each other, so one stays; copies without an id go with the first document
    assert [i for i, _ in kept] == [1, 3, 5, 6, 7] and dict(kept)[1] == one[1] and dict(kept)[3] in three
    assert b.where("text IS NULL").count() == 1
    c = P.without_repeats(spark, df, SF)
    got = {(r.doc_id, r.text and r.text.strip()) for r in c.collect()}
    assert c.columns == df.columns and (2, "more") in got and (7, "") in got and (4, None) in got and (None, "") in got and (1, one[1]) in got
    assert c.count() == len(texts)
    assert len({t for i, t in got if i == 3}) == 2 and max(len(t) for i, t in got if i == 3) > 200  # the first of both is whole
    d = P.mixed(spark, df, SF)
    assert d.columns == df.columns and {(r.doc_id, r.text) for r in d.collect()} <= texts
    assert P.encoded(spark, df, SF).count() == df.count()


def test_texts_that_share_an_id_or_have_none(spark):
    """Each distinct text survives or goes by a decision; copies without an id are found."""
    rng = np.random.default_rng(4)

    def prose(n):
        return " ".join(f"the word{rng.integers(10**6)} of" for _ in range(n))

    texts = [prose(60) for _ in range(8)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[0]), (2, texts[2] + " end"), (3, texts[4]), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id int, text string, lang string, source string")
    b = P.one_of_each_group(spark, df, SF)
    want = [(1, texts[0]), (1, texts[1]), (2, texts[2] + " end"), (3, texts[4]), (None, texts[3]), (None, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in b.collect()))) == sorted(map(str, want)) and b.schema == df.schema
    c = {(r.doc_id, r.text) for r in P.without_repeats(spark, b, SF).collect()}
    assert c == set(want)  # nothing repeats any more
    d = P.mixed(spark, df, SF)
    size = {r.text: 0 for r in df.collect()}
    for r in d.collect():
        size[r.text] += 1
    assert set(size.values()) <= {0, 1, 2, 3} and sum(n > 0 for t, n in size.items() if t) >= 5
