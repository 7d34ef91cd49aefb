"""Operators 2, 5, 6 and 10 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, near_vectors, repeated_passages, top_k
from tessera.llm.components import components

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text, lower=True):
    t = text or ""
    if lower:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    for s in SPACES[1:]:
        t = t.replace(s, " ")
    return [w for w in t.split(" ") if w]


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute_components(rows):
    """rows: (id, text) -> sorted (id, size, component)."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))
    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    pairs = {(a, b) for v in index.values() for k, a in enumerate(v) for b in v[k + 1:]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[find(parent, a)] = find(parent, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(parent, i)
        ids = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(ids) if ids else None
    return sorted(((d, len(sets[i]), least[find(parent, i)]) for i, (d, _) in enumerate(rows)), key=str)


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def variants(rng, n, length, edits, vocabulary=4000):
    base = [f"w{rng.integers(vocabulary)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for p in rng.integers(0, length, rng.integers(0, edits + 1)):
            w[p] = f"x{rng.integers(10**9)}"
        out.append(" ".join(w))
    return out


def test_jaccard_components_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", " \n", "a", "A", "a b", "a  b\n", "one two three four five", "ONE two three four five", "one two three four five six"]
    texts += variants(rng, 40, 60, 4) + variants(rng, 40, 40, 3) + variants(rng, 30, 200, 9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join([*(f"r{rng.integers(10**8)}" for _ in range(40)), passage]) for _ in range(30)]
    texts += [passage] * 3 + ["long " * 5000 + "x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, i, 1) for i, t in rows], "doc_id long, text string, component_id long, n long")
    want = brute_components(rows)
    for frequent in (64, 3):
        out = jaccard_join.jaccard_components(df, frequent=frequent)
        assert collected(out, "doc_id", "n_shingles", "component_id") == want


def test_jaccard_chains_need_the_later_rounds(spark):
    """A chain of neighbours, each linked with the next only: pivots alone do not join them."""
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(24):
        w = list(base)
        for j in range(k):
            w[5 * j] = f"c{j}"
        rows.append((100 - k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for frequent in (64, 5):
        assert collected(jaccard_join.jaccard_components(df, frequent=frequent), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def bridged_families(seed):
    """Two families of 5 to 10 variants; one link alone, of the second's first and the first's second, joins them."""
    rng = np.random.default_rng(seed)
    length = int(rng.integers(140, 150))
    places = rng.permutation(np.arange(0, length, 6))
    shared, bridge, free = places[:1], places[1:4], places[4:]
    near = [[], [*shared]] + [[free[i]] for i in range(rng.integers(3, 9))]
    link = [*shared, *bridge]
    far = [link] + [[*link, *rng.choice(free, rng.integers(1, 4), replace=False)] for _ in range(rng.integers(4, 10))]
    texts = []
    for changed in near + far:
        words = [f"s{seed}w{i}" for i in range(length)]
        for p in changed:
            words[p] = f"s{seed}x{p}"
        texts.append(" ".join(words))
    return texts


def test_jaccard_boundaries_of_two_cells(spark):
    """The link joins members that are both further than a link from the other cell's pivot."""
    rows = list(enumerate(t for seed in range(60) for t in bridged_families(seed)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for frequent in (16, 3):
        assert collected(jaccard_join.jaccard_components(df, frequent=frequent), "doc_id", "n_shingles", "component_id") == want


@pytest.mark.parametrize("leaf, pivots, levels, copies, together", [(6, 3, 3, 2, 4), (4, 2, 1, 100, 1), (5, 4, 2, 0, 100), (8, 8, 0, 2, 0)])
def test_jaccard_recursion_and_tiles(spark, monkeypatch, leaf, pivots, levels, copies, together):
    """Small leaves, so that regions are split, not parted, compared in tiles, and cells have tiles of their own."""
    for name, value in (("LEAF", leaf), ("PIVOTS", pivots), ("LEVELS", levels), ("COPIES", copies), ("TOGETHER", together)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(leaf)
    texts = [t for seed in range(12) for t in bridged_families(seed)]
    texts += variants(rng, 60, 60, 4) + variants(rng, 60, 90, 2)
    passage = " ".join(f"p{i}" for i in range(60))
    for k in range(6):  # families that share a passage, and texts with nothing else in common
        texts += [t + " " + passage for t in variants(rng, 8, 50, 3)]
    texts += [" ".join([*(f"r{rng.integers(10**8)}" for _ in range(40)), passage]) for _ in range(30)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.jaccard_components(df, frequent=8)
    assert collected(out, "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_overlaps_of_sets():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sets = [[np.unique(rng.integers(0, 40 if rng.random() < 0.5 else 4000, rng.integers(0, 60)).astype(np.uint64)) for _ in range(rng.integers(1, 30))] for _ in "ab"]
        flat = [(np.concatenate(s), np.append(0, np.cumsum([len(x) for x in s]))) for s in sets]
        for i, j in ((0, 1), (0, 0)):
            want = [[len(np.intersect1d(p, q)) for q in sets[j]] for p in sets[i]]
            assert jaccard_join.overlaps(flat[i], flat[j]).tolist() == want


def test_jaccard_repeats_nulls_and_empty(spark):
    t = "the same five words here again"
    rows = [(5, t), (5, t), (None, t), (7, "other words in this one document"), (None, "words that nobody else has here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(jaccard_join.jaccard_components(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert jaccard_join.jaccard_components(df.limit(0)).collect() == []


def test_jaccard_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert collected(jaccard_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == want


def test_components_of_shapes(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200, 202: 200}


# -- vectors ------------------------------------------------------------------

def brute_near(rows, threshold):
    good = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(v)
    unit = {i: np.array(min(v), float) / np.linalg.norm(np.array(min(v), float)) for i, v in good.items()}
    ids = sorted({i for i, _ in rows})
    parent, links = {i: i for i in ids}, dict.fromkeys(ids, 0)
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                ra, rb = find(parent, a), find(parent, b)
                parent[max(ra, rb)] = min(ra, rb)
    return [(i, links[i], find(parent, i), find(parent, i) == i) for i in ids]


def vector_rows():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for size, noise in ((30, 0.05), (40, 0.03), (20, 0.0), (60, 0.2), (100, 2.0)):
        c = rng.normal(size=16)
        for _ in range(size):
            rows.append((n, [float(np.float32(x)) for x in c + noise * rng.normal(size=16)]))
            n += 1
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    return rows + [(n + i, v) for i, v in enumerate(bad)]


def test_near_vectors_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links int, vector string")
    want = brute_near(rows, 0.95)
    for tile in (1024, 7):
        got = collected(near_vectors.near_vectors(df, tile=tile), "vec_id", "n_links", "component_id", "kept")
        assert got == sorted(want, key=str)
    assert near_vectors.near_vectors(df.limit(0)).collect() == []
    twice = df.union(df).union(spark.createDataFrame([(None, [1.0] * 16, 1, "y")], df.schema))
    got = collected(near_vectors.near_vectors(twice), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([*want, (None, 0, None, True)], key=str)


def test_near_vectors_recall_on_embeddings(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_near([(r.vec_id, r.embedding) for r in e.collect()], 0.95)
    got = collected(near_vectors.near_vectors(e), "vec_id", "n_links", "component_id", "kept")
    links = sum(w[1] for w in want)
    assert all(a[1] <= b[1] for a, b in zip(got, sorted(want, key=str)))
    assert sum(g[1] for g in got) >= 0.99 * links


def test_top_k_brute_force(spark):
    rows = [(i, v) for i, v in vector_rows() if i is not None]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, x in good.items():
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in good.items() if c != q and len(x) == len(y))[:20]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    for tile in (1024, 10):
        got = top_k.top_k(df, F.col("vec_id") % 20 == 0, tile=tile)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    twice = top_k.top_k(df.union(df), F.col("vec_id") % 20 == 0, tile=64)
    assert sorted(tuple(r) for r in twice.collect()) == sorted(want)


def test_top_k_ties_and_large_values(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)] + [(100, [2.0**40, 0.0]), (120, [2.0**21, 0.0])], "vec_id long, embedding array<double>")
    out = top_k.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [100, 120, *range(1, 19)]
    with pytest.raises(Exception, match="64 bits"):
        top_k.top_k(df, F.col("vec_id") == 100, scale=1 << 20).collect()


# -- repeated passages ----------------------------------------------------------

def brute_ranges(rows, length):
    docs = {}
    for i, t in rows:
        if i is not None:
            docs[i] = min([x for x in (docs.get(i), t or "") if x is not None])
    seen = {}
    for i in sorted(docs):
        w = words_of(docs[i], lower=False)
        for s in range(len(w) - length + 1):
            seen.setdefault(tuple(w[s:s + length]), []).append((i, s))

    def union(starts):
        out = []
        for s in sorted(starts):
            if out and s <= out[-1][1]:
                out[-1][1] = s + length
            else:
                out.append([s, s + length])
        return out

    passages, drop = {}, {}
    for places in seen.values():
        if len(places) > 1:
            for k, (i, s) in enumerate(places):
                passages.setdefault(i, []).append(s)
                if k:
                    drop.setdefault(i, []).append(s)
    return {i: (union(s), union(drop.get(i, []))) for i, s in passages.items()}


def passage_rows():
    rng = np.random.default_rng(5)
    rand = lambda n, v=10**8: [f"r{rng.integers(v)}" for _ in range(n)]
    p60, p50, p49, p130 = rand(60), rand(50), rand(49), rand(130)
    texts = [rand(100) + p60 + rand(30), p60 + rand(20), rand(7) + p60, rand(80) + p50, p50 + rand(80), rand(60) + p49, p49 + rand(60),
             p130, rand(10) + p130[20:100] + rand(10), p130[:70] + rand(40) + p130[60:], ["a"] * 200, ["a"] * 120 + rand(5),
             ["a", "b"] * 80, rand(50), rand(49), [], rand(300), rand(20) + rand(30, 3) * 4]
    texts += [p130] * 4 + [p130[:64] + ["edit"] + p130[65:]] * 2
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(500, None), (501, "  \n"), (None, " ".join(p60)), (502, "Wort\tÄ " + "\n".join(p60))]


def test_repeated_ranges_brute_force(spark):
    rows = passage_rows()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key long, pos int")
    want = brute_ranges(rows, 50)
    got = {r.doc_id: ([list(x) for x in r.passages], [list(x) for x in r["drop"]]) for r in repeated_passages.repeated_ranges(df).collect()}
    assert got == want
    again = df.union(df.where("doc_id = 3"))
    assert repeated_passages.repeated_ranges(again).count() == len(want)
    assert repeated_passages.repeated_ranges(df.limit(0)).collect() == []


def test_repeated_passages_other_lengths(spark):
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_ranges(rows, 12)
    got = {r.doc_id: ([list(x) for x in r.passages], [list(x) for x in r["drop"]]) for r in repeated_passages.repeated_ranges(df, length=12, gram=4).collect()}
    assert got == want


def test_repeated_passages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_ranges(rows, 50)
    out = collected(repeated_passages.repeated_passages(docs), "doc_id", "first_word", "n_words", "n_dropped")
    assert out == sorted(((i, a, b - a, sum(max(0, min(b, d[1]) - max(a, d[0])) for d in drop))
                          for i, (pas, drop) in want.items() for a, b in pas), key=str)


def test_deduplicated_texts(spark):
    p = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"first  {p} tail"), (2, f"second {p}\nrest of it"), (3, p), (4, "nothing here")]
    out = {r.doc_id: r.kept_text for r in repeated_passages.deduplicated_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {2: "second rest of it", 3: ""}


def test_partial_selection_with_ties():
    rng = np.random.default_rng(8)
    for _ in range(200):
        scores = rng.integers(-3, 4 if rng.random() < 0.5 else 1000, (rng.integers(1, 6), rng.integers(1, 40)))
        m = int(rng.integers(1, scores.shape[1] + 1))
        got = top_k._best(scores, m)
        want = np.argsort(-scores, axis=1, kind="stable")
        assert got[:, :m].tolist() == want[:, :m].tolist()


def test_products_beyond_doubles():
    big = np.array([[2.0**40, 3.0], [-(2.0**33), 1.0]])
    small = np.array([[2.0**31, 1.0], [2.0**30, -5.0]])
    assert top_k._products(small, small).tolist() == [[2**62 + 1, 2**61 - 5], [2**61 - 5, 2**60 + 25]]
    with pytest.raises(ValueError, match="64 bits"):
        top_k._products(big, big)


@pytest.mark.parametrize("n", [600, 3000])
def test_near_vectors_recall_on_planted_pairs(spark, n):
    """Pairs planted at cosines of 0.93 to 0.97 among vectors in random directions."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = n // 4
    for i in range(pairs):
        side = rng.normal(size=32)
        side -= side @ x[i] * x[i]
        cosine = rng.uniform(0.93, 0.97)
        x[n - 1 - i] = cosine * x[i] + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = near_vectors.near_vectors(df).collect()
    links = sum(r.n_links for r in rows) / 2
    assert len(want) > pairs / 3 and len(want) >= links >= 0.99 * len(want)
    linked = {i for p in want for i in p}
    assert {r.vec_id for r in rows if r.n_links} <= linked


def test_tables_follow_the_number_of_vectors():
    assert near_vectors.bits_and_tables(1000) == near_vectors.bits_and_tables(4_000_000) == (12, 24)
    bits, tables = near_vectors.bits_and_tables(10**9)
    assert bits == 20 and (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 4e-4
