"""Operators 1, 3, 4, 7, 8 and 9 on hand-made rows and against plain versions."""

import hashlib
import json
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe_codec, language_id, license_scan, mixing, simple8b, token_counts, token_files
from tessera.llm.shared import shared_dir

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " \n\t ", "Hello, WORLD's don't we'll 1234", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "Σας ΟΔΟΣ İstanbul ẞ ǅ",
    "x\x1cy z q\u0085w", "日本語 テスト 😀😀 각", "éè ́ Å", "aaaaa aaaa aaa aa", "zero​width ﻿bom", "word " * 30000, "Hello, WORLD's don't we'll 1234",
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, 1, "ids") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, "x")]
    return spark.createDataFrame(data, "doc_id long, text string, n_tokens int, ids string")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_codec.default_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_bpe_encode_decode_equal_the_library(spark, rows, library):
    enc = bpe_codec.encode(rows)
    got = {r.doc_id: r.ids for r in enc.collect()}
    dec = {r.doc_id: r.text for r in bpe_codec.decode(enc).collect()}
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        ids, text = expected(library, t)
        assert got[i] == ids and dec[i] == text
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe_codec.decode(none).collect()} == {1: None, 2: ""}
    with pytest.raises(Exception, match="token id outside"):
        bpe_codec.decode(spark.createDataFrame([(1, [49408])], "doc_id long, ids array<int>")).collect()


def test_bpe_digests_on_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in bpe_codec.round_trip_digests(docs).collect()}
    for r in docs.collect():
        ids, text = expected(library, r.text)
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_codec.round_trip_digests(docs.limit(0)).collect() == []


def test_bpe_merge_index_equals_one_merge_at_a_time():
    model = bpe_codec.load_model(bpe_codec.default_path())
    rank = {(a, b): (r, p) for r, (a, b, p) in enumerate(zip(model.left.tolist(), model.right.tolist(), model.product.tolist()))}
    rng = np.random.default_rng(0)
    words = [bytes(rng.choice(list(b"aaabeinrst"), rng.integers(1, 14)).tolist()) for _ in range(400)]
    data, offsets = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    ids, ends = model.merge(data, offsets)
    for k, w in enumerate(words):
        s = [int(model.inner[c]) for c in w[:-1]] + [int(model.last[w[-1]])]
        while (best := min(((rank[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in rank), default=None)):
            i = best[1]
            s[i:i + 2] = [rank[s[i], s[i + 1]][1]]
        assert ids[ends[k]:ends[k + 1]].tolist() == s


# -- token files ----------------------------------------------------------------

@pytest.mark.parametrize("values", [
    [], [0], [2**64 - 1, 0, 2**60, 5, 2**60 - 1, 2**63], list(range(3000)), [0] * 5000, [1] * 61, [2**30] * 1025])
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    assert (simple8b.decode(simple8b.encode(v)) == v).all()


def test_simple8b_mixed_widths():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 1 << 63, 20000, dtype=np.uint64) >> rng.integers(0, 63, 20000).astype(np.uint64)
    assert (simple8b.decode(simple8b.encode(v)) == v).all()
    small = rng.integers(0, 2, 60 * 1024)
    assert len(simple8b.encode(small, block=6000)) < 60 * 1024 / 7  # one bit each and the block offsets
    with pytest.raises(ValueError):
        simple8b.decode(b"other bytes here")


def test_token_files_round_trip(spark, rows, library):
    path = f"{shared_dir(spark)}/t"
    token_files.write_token_files(rows, path, shards=3)
    got = [(r.doc_id, r.start, r.ids) for r in token_files.read_token_files(spark, path).orderBy("start").collect()]
    want, start = [], 0
    for i, t in [(None, "no id"), *enumerate(TEXTS)]:
        ids = expected(library, t)[0] + [1]
        want.append((i, start, ids))
        start += len(ids)
    assert got == want
    dig = {r.doc_id: r for r in token_files.token_file_digests(spark, path).collect()}
    for i, s, ids in want:
        assert (dig[i].start, dig[i].n_tokens, dig[i].ids_crc32) == (s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert token_files.round_trip(rows.limit(0)).collect() == []
    assert token_files.round_trip(rows.union(rows)).count() == 2 * len(want)


def test_token_files_library_gets_a_piece_once(library):
    class Recorder:
        def __init__(self, inner):
            self.inner, self.sent = inner, []

        def encode(self, text, **options):
            self.sent += text.split(" ")
            return self.inner.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            self.sent += [piece for text in texts for piece in text.split(" ")]
            return self.inner.encode_batch_fast(texts, **options)

    model = token_files.LibraryModel(bpe_codec.default_path())
    model.model = Recorder(model.model)
    for words in (["thatndou,", "thatndou.", "(hewh"], ["thatndou!", "hewh", "THATNDOU,x7"], ["thatndou,", "</w>thatndou</w>"]):
        ids, offsets = model.encode_words(pa.array(words))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [expected(library, w)[0] for w in words]
    assert len(model.model.sent) == len(set(model.model.sent))


@pytest.mark.parametrize("kept", [0, 3, 1 << 19])
def test_token_files_ids_do_not_depend_on_what_is_kept(library, monkeypatch, kept):
    monkeypatch.setattr(token_files, "KEPT", kept)
    model = token_files.LibraryModel(bpe_codec.default_path())
    rng = np.random.default_rng(7)
    for _ in range(4):
        words = sorted({"".join(rng.choice(list("aeinst,.'7é語</w>"), rng.integers(1, 9))) for _ in range(60)} | {"a<|endoftext|>b"})
        ids, offsets = model.encode_words(pa.array(words))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [expected(library, w)[0] for w in words]
        assert len(model.words.items) <= kept and len(model.pieces.items) <= kept
    ids, offsets = model.encode_words(pa.array([], pa.string()))
    assert len(ids) == 0 and offsets.tolist() == [0]


def test_simple8b_takes_the_most_values_a_word_where_small_ones_are_rare():
    rng = np.random.default_rng(9)
    v = np.where(rng.random(6000) < 0.1, rng.integers(0, 9, 6000), rng.integers(1 << 14, 1 << 17, 6000)).astype(np.uint64)
    v[1000:1070], v[2040:2060], v[-40:] = 1, 3, 0
    data, count = simple8b.encode(v), 0
    assert (simple8b.decode(data) == v).all()
    for lo in range(0, len(v), simple8b.BLOCK):
        left = v[lo:lo + simple8b.BLOCK].tolist()
        while left:
            n = next(n for n, bits in simple8b.SELECTORS if max(left[:n]) < 1 << bits)
            left, count = left[n:], count + 1
    blocks = -(-len(v) // simple8b.BLOCK)
    assert len(data) == -(-(24 + 4 * (blocks + 1)) // 8) * 8 + 8 * count


# -- token counts -----------------------------------------------------------------

def greedy(word, begin, inside):
    n = at = 0
    while at < len(word):
        pieces = begin if at == 0 else inside
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def test_longest_match_small_vocabularies():
    rng = np.random.default_rng(2)
    for _ in range(60):
        begin = {bytes(rng.choice(list(b"abc"), rng.integers(1, 5)).tolist()) for _ in range(rng.integers(1, 9))}
        inside = {bytes(rng.choice(list(b"abc"), rng.integers(1, 6)).tolist()) for _ in range(rng.integers(1, 9))}
        words = [bytes(rng.choice(list(b"abcd"), rng.integers(0, 12), p=[.4, .3, .25, .05]).tolist()) for _ in range(200)]
        data = np.frombuffer(b"".join(words), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        got = token_counts.LongestMatch(sorted(begin), sorted(inside)).counts(data, offsets)
        assert got.tolist() == [greedy(w, begin, inside) for w in words]


def test_token_counts(spark, rows):
    spec = json.load(open(token_counts.default_path()))
    byte_of = {c: b for b, c in enumerate(bpe_codec.byte_symbols())}
    pieces = {bytes(byte_of[c] for c in n) for n in spec["model"]["vocab"] if n != "<|endoftext|>"}
    begin, inside = {p for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "}
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(rows).collect()}
    for i, t in enumerate(TEXTS):
        words = [w for w in (t or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
        seen = {w: greedy(b" " + w, begin, inside) for w in set(words)}
        assert got[i] == (len(words), sum(seen[w] for w in words), 0)
    tiny = token_counts.LongestMatch([b" a"], [b"b"])
    df = spark.createDataFrame([(1, "a ab abb c ba"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(df, automaton=tiny).collect()}
    assert got == {1: (5, 8, 2), 2: (0, 0, 0)}
    assert token_counts.token_counts(df.limit(0)).collect() == []


# -- mixing -------------------------------------------------------------------------

def test_mix_equals_its_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, size, source_size, copies, taken, target FROM ({mixing.ORACLE_SQL})").fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.copies, r.taken, r.target) for r in mixing.mix(docs).collect()}
    assert got.keys() == want.keys()
    for k, g in got.items():
        assert g[:4] == want[k][:4] and math.isclose(g[4], want[k][4], rel_tol=1e-12)


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in free})
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
        free -= over
    return target


def test_mix_targets_nulls_and_copies(spark):
    rng = np.random.default_rng(8)
    data = []
    for i in range(1500):
        source = [None, "", "a", "b", "Z", "ü", "tiny"][min(int(rng.exponential(1.2)), 6)]
        text = None if i % 97 == 0 else "w " * int(rng.integers(0, 40 if i % 50 else 2000))
        data.append((i, text, source, 5))
    data += [(2000 + i, "same text for all of these", "a", 5) for i in range(700)] + [(3000, "", "nothing", 5), (None, "x y", None, 5)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    out = mixing.mix(df).collect()
    assert len(out) == len(data)
    by_id = {r.doc_id: r for r in out}
    sizes, taken = {}, {}
    for i, t, s, _ in data:
        n = len((t or "").split())
        assert by_id[i]["size"] == n and 0 <= by_id[i].taken <= 3 * n and by_id[i].taken == by_id[i].copies * n
        sizes[s], taken[s] = sizes.get(s, 0) + n, taken.get(s, 0) + by_id[i].taken
    want = plain_targets(sizes)
    for i, t, s, _ in data:
        assert math.isclose(by_id[i].target, want[s], rel_tol=1e-9) and by_id[i].source_size == sizes[s]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2000 + 0.02 * want[s]
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, out))
    assert mixing.mix(df.limit(0)).collect() == []
    assert {r.target for r in mixing.mix(df.where("doc_id = 3000")).collect()} == {0.0}


# -- language identification -----------------------------------------------------------

def test_language_id_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out) and sum(r.accepted for r in out) >= 0.99 * len(out)


def test_language_id_edges(spark):
    data = [(i, "der die das und nicht ist" if i % 2 else "the and of that is not", "de" if i % 2 else "en", "x") for i in range(60)]
    data += [(100, None, "de", "x"), (101, "", "de", "x"), (102, "123 %% !", "en", "x"), (103, "der und das", None, "x"),
             (None, "the of and", "en", "x"), (104, "THE " * 20000, None, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"} and not any(got[i].accepted for i in (100, 101, 102))
    assert got[103].lang_pred == "de" and got[104].lang_pred == "en" and got[None].lang_pred == "en" and not got[None].held_out
    assert language_id.identify(df.limit(0)).collect() == []
    unlabelled = language_id.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_subword_grams():
    grams, offsets = language_id.subwords(["ab", "1", "x,y", "", "AB"])
    assert np.diff(offsets).tolist() == [8, 0, 8, 0, 8] and grams[:8].tolist() == grams[-8:].tolist()


def test_language_sample_without_ids(spark):
    rows = [(None, f"the word{i} of and", "en") for i in range(1500)] + [(7, f"der wort{i} und das", "de") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.sample_features(df, 400)
    assert all(150 <= sum(r.lang == lang for r in sample) <= 250 for lang in ("en", "de"))


# -- licence scan -----------------------------------------------------------------------

def brute_licenses(text, templates):
    import re

    def grams(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return w, [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    words, have = grams(text)
    out = set()
    for name, t in templates.items():
        tw, tg = grams(t)
        want = set(tg)
        for s in range(max(1, len(words) - len(tw) + 1)):
            if len(want & set(have[s:s + len(tw) - 4])) >= 0.8 * len(want) - 1e-9:
                out.add(name)
                break
    return out


def test_license_scan(spark):
    t = license_scan.TEMPLATES
    gpl = t["GPL notice"].split()
    data = [(i, f"some words before it {x} and after it", 1) for i, x in enumerate(t.values())]
    data += [(50, " ".join(t.values()), 1), (51, None, 1), (52, "", 1), (53, "released under the mit", 1), (54, "RELEASED under the MIT license!!", 1),
             (55, " ".join([*gpl[:20], "odd", *gpl[21:]]), 1), (56, " ".join(gpl[::2]), 1), (57, "word " * 50000 + t["MIT line"], 1),
             (58, t["MIT line"] + " " + t["MIT line"], 1), (58, t["MIT line"], 1), (None, t["MIT line"], 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, license int")
    got = {}
    for r in license_scan.license_scan(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for i, text, _ in data:
        assert got.get(i, set()) == brute_licenses(text, t), i
    assert license_scan.license_scan(df.limit(0)).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {(r.doc_id, r.license) for r in license_scan.license_scan(docs).collect()}
    assert found == {(r.doc_id, n) for r in docs.collect() for n in brute_licenses(r.text, t)}


def test_license_scan_of_other_licences(spark):
    notices = {
        "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                           "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                           "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GPL-2.0-only notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                               "License version 2 as published by the Free Software Foundation.",
        "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                          "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                     "provided that the above copyright notice and this permission notice appear in all copies.",
        "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "CC0-1.0 waiver": "To the extent possible under law, A. Writer has waived all copyright and related or neighboring rights to this text.",
        "Unlicense": "This is free and unencumbered software released into the public domain."}
    df = spark.createDataFrame([(i, f"before it {x} and after it") for i, x in enumerate(notices.values())], "doc_id long, text string")
    best = {}
    for r in license_scan.license_scan(df).collect():
        best[r.doc_id] = max(best.get(r.doc_id, (0, "")), (r.containment, r.license))
    assert {i: name for i, (_, name) in best.items()} == dict(enumerate(notices))


def test_bands_guarantee():
    for c in license_scan.length_classes(license_scan.TEMPLATES):
        for s in c.shingles:
            n = len(s)
            common = math.ceil(0.8 * n - 1e-9)
            least = common / (n + c.width - 4 - common)
            assert (1 - least) ** c.bands <= 1e-6
    assert pa.__version__
