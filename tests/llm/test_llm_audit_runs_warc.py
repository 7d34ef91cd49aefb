"""Operators 11, 12 and 13 on hand-made rows and against plain versions."""

import base64
import gzip
import hashlib
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tessera.llm import filter_audit, periodic_runs, queries, warc
from tessera.llm.ragged import offsets_of
from tessera.llm.shared import shared_dir
from tessera.llm.text_trie import TextTrie

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# ---- 11: filter audit

def plain_masks(rows):
    """(doc_id, part, mask) by the definitions."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, source in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i]
        out.append((i, source or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


def plain_audit(masks, labels):
    out = {}
    removed = {}
    for part in {p for _, p, _ in masks}:
        rows = [(i, m) for i, p, m in masks if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                here = [(i, m) for i, m in left if m & bit]
                left = [(i, m) for i, m in left if not m & bit]
                good, toxic = (sum(labels.get(i, (0, 0))[k] == 1 for i, _ in here if i is not None) for k in (0, 1))
                out[part, order, step] = [len(left), len(here), sum(1 for _, m in rows if m & bit) - len(here),
                                          sum(1 for _, m in rows if m == bit), good, toxic]
                removed[part, f] = removed.get((part, f), 0) + len(here)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got_audit(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def audit_rows():
    rng = np.random.default_rng(11)
    words = [f"w{i}é" for i in range(300)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    base, long = prose(200), prose(30_000)
    texts = [None, "", " \t\n", base, base, base + " x", base[:50], "A" * 30, "a #", "a\x85b\xa0c " * 60, long, long, long + "!", "x " * 40, "Ä" * 10]
    texts += [base[:k] for k in (7, 8, 9, 31, 32, 33, 127, 128, 129)] * 2
    texts += [base[:300] + prose(30) for _ in range(60)] + [base] * 150  # a group of near copies and one of copies
    rows = [(int(i), t, [None, "", "s", "t"][k % 4]) for k, (i, t) in enumerate(zip(rng.permutation(len(texts)) - 20, texts))]
    return rows + [rows[3], rows[3], (None, base, "s"), (None, None, None), (rows[5][0], "another text of that id", "s")]


def test_trie_holds_whole_texts():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(["a", "b", "é"], rng.integers(0, 9))) for _ in range(500)]
    trie, least = TextTrie(), {}
    for i, t in zip(rng.permutation(500).tolist(), texts):
        trie.insert(t.encode(), i, (i, t))
        least[t] = min(i, least.get(t, i))
    found = {rows[0][1]: (n, {t for _, t in rows}, len(rows)) for n, rows in trie.terminals()}
    assert found == {t: (least[t], {t}, texts.count(t)) for t in texts}


@pytest.mark.parametrize("cell_bytes", [1 << 16, 100])
def test_audit_of_odd_rows(spark, monkeypatch, cell_bytes):
    monkeypatch.setattr(filter_audit, "CELL_BYTES", cell_bytes)
    monkeypatch.setattr(filter_audit, "CELLS", 50)
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, source string, part string, mask int").repartition(7)
    if cell_bytes == 100:
        heavy = filter_audit._heavy_prefixes(docs.select("text", filter_audit._prefix_hashes(filter_audit.F.coalesce("text", filter_audit.F.lit(""))).alias("hashes")), 8)
        assert len(heavy) > 3  # prefixes are really extended
    masks = sorted(map(str, ((r.doc_id, r.part, r.mask) for r in filter_audit.filter_masks(docs).collect())))
    want = plain_masks(rows)
    assert masks == sorted(map(str, want))
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "x"), (2, None, 1, "x"), (3, 1, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, part string")
    assert got_audit(filter_audit.filter_audit(docs, labels)) == plain_audit(want, {1: (1, 1), 2: (0, 1), 3: (1, 0)})


def test_audit_of_empty_tables(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    assert filter_audit.filter_audit(docs.limit(0), labels).collect() == []
    got = filter_audit.filter_audit(docs.limit(30), labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(got) == (0, 0)


def test_audit_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.op11_filter_audit(spark, SF)
    cols = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {cols} FROM ({filter_audit.ORACLE_SQL})").fetchall())


# ---- 12: periodic runs

def plain_runs(w, least=24, exponent=3):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, exponent * q):
                found.setdefault((s, i + q - s), q)  # the smallest period of a stretch comes first
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least, exponent", [(24, 3), (4, 2), (9, 3), (2, 2), (12, 4)])
def test_runs_of_random_words(least, exponent):
    rng = np.random.default_rng(least)
    for _ in range(60):
        texts = []
        for _ in range(4):
            n = int(rng.integers(0, 90))
            w = rng.integers(0, rng.integers(1, 5), n)
            if n and rng.random() < 0.6:
                a = int(rng.integers(0, n))
                i = np.arange(n)
                w = np.where(i >= a, w[np.minimum(a + (i - a) % (1 + int(rng.integers(0, max(1, (n - a) // 3)))), n - 1)], w)
            texts.append(w)
        found = periodic_runs.find_runs(np.concatenate(texts).astype(np.int32), offsets_of(np.array([len(t) for t in texts])), least, exponent)
        got = [[] for _ in texts]
        for t, *r in zip(*(x.tolist() for x in found)):
            got[t].append(tuple(r))
        assert got == [plain_runs(t.tolist(), least, exponent) for t in texts]


def test_runs_of_odd_rows(spark):
    beat = "a b c " * 20
    texts = [None, "", " \n", "one", beat, beat + beat.upper(), "x " * 23, "x " * 24, "x\x0by\x1cz " * 12, "u v " * 9 + "w " + "u v " * 9 + "w " + "u v " * 9 + "w",
             " ".join(str(i % 1000) for i in range(30_000)), "q " * 50_000, "é\xa0è " * 30, beat]
    rows = [(i, t, "k", 3) for i, t in enumerate(texts)] + [(4, beat, "k", 3), (None, beat, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = sorted(map(str, ((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in periodic_runs.periodic_runs(df).collect())))
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        long = {10: [(0, 30_000, 1000)], 11: [(0, 50_000, 1)]}  # by hand: the plain version takes too long
        runs = long[i] if i in long else plain_runs(w)
        want.append((i, len(w), runs, plain_collapsed(w, runs)))
    assert got == sorted(map(str, want))
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.periodic_runs(df, exponent=1)


def test_run_query_equals_plain_version(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    some = 0
    for d in table(spark, "documents").collect():
        w = WORD.findall(d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(w)
        r = got[d.doc_id]
        some += bool(runs)
        assert r.n_runs == len(runs)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None,) * 3
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
    assert some > 10


# ---- 13: WARC

def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain_pages(rows, least=0):
    top = {}
    for i, html in rows:
        if i is not None:
            top[html] = max(i, top.get(html, i))
    out = []
    for i, html in rows:
        p = (html or b"") if isinstance(html, bytes) else (html or "").encode()
        t = top.get(html) if len(p) >= least else None
        again = t is not None and i != t
        out.append((i, len(p), sha1(p), "revisit" if again else "response", t if again else None))
    return sorted(map(str, out))


def odd_pages():
    rng = np.random.default_rng(13)
    return [(1, "a"), (2, None), (3, ""), (4, "<p>é</p>" * 3), (5, "<p>é</p>" * 3), (5, "<p>é</p>" * 3), (6, "a"), (7, "WARC/1.1\r\n\r\n" * 9), (8, "\x1f\x08 x"),
            (9, "".join(rng.choice(list("abcdefgh é"), 400_000))), (None, "a"), (None, "nobody"), (None, "nobody"), (-3, "same\r\n\r\nrows"), (-3, "same\r\n\r\nrows"),
            *((100 + i, "hot page " * 5) for i in range(300)), *((1000 + i, f"page {i} " + "x" * int(rng.integers(0, 3000))) for i in range(300))]


@pytest.mark.parametrize("split, size, least", [(1 << 25, 1 << 30, 0), (700, 20_000, 0), (64, 1 << 30, 10)])
def test_pages_come_back_whatever_the_ranges(spark, split, size, least):
    rows = odd_pages()
    urls = [None, "", "http://a.b/c?d=e#f", "http://é.x/\r\nWARC-Type: response", "::::"]
    pages = spark.createDataFrame([(i, urls[k % 5], h, "x", 1) for k, (i, h) in enumerate(rows)],
                                  "page_id long, url string, html string, original string, bytes int").repartition(3)
    folder = f"{shared_dir(spark)}/warc"
    files = warc.write_warc(pages, folder, least_bytes=least, file_bytes=size)
    assert files.count() >= (3 if size > 1 << 20 else 6)
    got = warc.page_records(files, split)
    want = plain_pages([(i, h or "") for i, h in rows], least)
    assert sorted(map(str, map(tuple, got.collect()))) == want
    if split == 64:
        return
    # the archives are plain gzip: read whole by another reader, and found by listing
    listed = warc.list_warc(spark, folder)
    assert listed.count() == files.count()
    records = warc.read_warc(listed, split).collect()
    assert len(records) == len(rows) + files.count() and {r.intact for r in records} == {True, None}
    whole = {p: open(warc.file_system(p)[1], "rb").read() for p in {r.path for r in records}}
    for r in records[::7]:
        data = gzip.decompress(whole[r.path][r.offset:r.offset + r.bytes])
        assert data.startswith(b"WARC/1.1\r\n") and (r.payload is None or bytes(r.payload) in data)
    assert sum(len(gzip.decompress(b)) for b in whole.values()) > 400_000
    responses = {(r.record_id.split(":")[3], bytes(r.payload)) for r in records if r.warc_type == "response"}
    assert ("9", dict(rows)[9].encode()) in responses and ("4", b"") not in responses


def test_false_magic_and_archives_within_archives(spark):
    inner = warc._member(warc._page_record(77, "u", b"inner", None, warc.DATE), 6)
    noise = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    payloads = [warc.MAGIC * 50, warc.MAGIC + b"\0" * 7 + noise, gzip.compress(b"no record"), noise + inner + noise, inner[:40] + noise, inner + inner]
    pages = spark.createDataFrame([(i, "u", p) for i, p in enumerate(payloads)], "page_id long, url string, html binary")
    files = warc.write_warc(pages.coalesce(1), f"{shared_dir(spark)}/warc", level=0)  # stored: the payloads stand in the file as they are
    want = plain_pages(list(enumerate(payloads)))
    assert sorted(map(str, map(tuple, warc.page_records(files).collect()))) == want
    for split in (50, 333):
        rows = warc.read_warc(files, split)
        kept = warc.outermost(rows).where("warc_type <> 'warcinfo'").collect()
        assert sorted((int(r.record_id.split(":")[3]), bytes(r.payload)) for r in kept) == list(enumerate(payloads))
    assert rows.count() > len(payloads) + 1  # there was something to take out


def test_empty_and_cut_archives(spark):
    pages = table(spark, "pages")
    assert warc.round_trip(pages.limit(0)).collect() == []
    files = warc.write_warc(pages.select("page_id", "url", "html").coalesce(1), f"{shared_dir(spark)}/warc")
    f = files.first()
    inner = warc.file_system(f.path)[1]
    data = open(inner, "rb").read()
    with open(inner, "wb") as out:
        out.write(data[:-100])
    cut = spark.createDataFrame([(f.path, len(data) - 100)], "path string, bytes long")
    assert warc.read_warc(cut, 4096).count() == f.records  # with the record on the software; the last page is cut
    bad = warc._page_record(1, "u", b"payload", None, warc.DATE).replace(b"payload", b"pAyload")
    with open(inner, "wb") as out:
        out.write(warc._member(bad, 6))
    wrong = spark.createDataFrame([(f.path, len(warc._member(bad, 6)))], "path string, bytes long")
    assert [r.intact for r in warc.read_warc(wrong).collect()] == [False]
    with pytest.raises(Exception, match="payload and digest differ"):
        warc.page_records(wrong).collect()


def test_warc_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    df = queries.op13_warc_round_trip(spark, SF)
    cols = ", ".join(df.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.execute(f"SELECT {cols} FROM ({warc.ORACLE_SQL})").fetchall()))
