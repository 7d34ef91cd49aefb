"""Repeated passages by a sparse suffix array over minimiser positions.

Of all suffixes only those are kept that begin at a minimiser: the least
16-word gram in some window of 50 words.  The choice looks at the window alone,
so every copy of a 50-word passage keeps the suffix at the same place in it.
Suffixes with an equal beginning meet when the suffixes are sorted by their
gram; each has the 34 words to its left and right that decide all windows
around it:

1.  Grams that occur once are dropped.
2.  Suffixes whose whole neighbourhood is equal form a class: if a gram has one
    class only, every window around it is repeated, in every occurrence.
3.  Where a gram has several classes, one suffix of each is extended to left and
    right: the hashes of all windows around it, which are then counted over all
    classes.
4.  Windows become word ranges of documents; the first occurrence of each window
    in the corpus is the one that stays.

So the passages found are exactly the maximal ranges of words of which every
word lies in a run of 50 words that occurs at another place too (runs are
compared as 64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.ragged import offsets_of, row_slices
from tessera.llm.shared import stored
from tessera.llm.wordhash import HASH_BYTES, PLAIN, Sequences, hash_words, longs, one_row_per_id

#: Words of the shortest passage, and of the gram at which suffixes are kept.
LENGTH = 50
GRAM = 16


def _anchors(hashes: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Suffix positions (flat), their texts, and the least and largest offset of a window around each."""
    count = offsets[1:] - offsets[:-1]
    reach = length - gram
    if len(hashes) < length:
        return (np.zeros(0, np.int64),) * 5
    seq = Sequences(hashes)
    at = np.arange(len(hashes) - gram + 1)
    grams = seq.of(at, at + gram)
    # least gram of each window, the leftmost of equal ones
    view = np.lib.stride_tricks.sliding_window_view(grams, reach + 1)
    starts = np.concatenate([np.arange(lo, hi - length + 1) for lo, hi in zip(offsets[:-1], offsets[1:]) if hi - lo >= length]
                            or [np.zeros(0, np.int64)])
    pos = np.empty(len(starts), np.int64)
    for lo in range(0, len(starts), 1 << 16):
        s = starts[lo:lo + (1 << 16)]
        pos[lo:lo + len(s)] = s + view[s].argmin(axis=1)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    text = np.repeat(np.arange(len(count)), np.maximum(count - length + 1, 0))
    fresh = np.concatenate([[True], (pos[1:] != pos[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(pos)) - 1
    most, least = pos[first] - starts[first], pos[last] - starts[last]
    return pos[first], text[first], least, most, seq


def _suffixes(length: int, gram: int):
    reach = length - gram

    def run(batches):
        for batch in row_slices(batches, "text", HASH_BYTES):
            words = hash_words(batch.column("text"), PLAIN)
            pos, text, least, most, seq = _anchors(words.hashes, words.offsets, length, gram)
            if not len(pos):
                continue
            lo, hi = words.offsets[:-1][text], words.offsets[1:][text]
            around = seq.of(np.maximum(pos - reach, lo), np.minimum(pos + gram + reach, hi))
            left = np.minimum(pos - lo, reach).astype(np.uint64)
            around ^= left * np.uint64(0x9E3779B97F4A7C15)  # where in its neighbourhood the gram stands
            yield pa.RecordBatch.from_arrays(
                [longs(seq.of(pos, pos + gram)), longs(around), batch.column("doc_id").take(pa.array(text)),
                 pa.array(pos - lo, pa.int32()), pa.array(least, pa.int8()), pa.array(most, pa.int8())],
                ["key", "around", "doc_id", "pos", "least", "most"])

    return run


def _windows(length: int):
    """Hashes of all windows around chosen suffixes of each text."""
    def run(batches):
        for batch in row_slices(batches, "text", HASH_BYTES):
            words = hash_words(batch.column("text"), PLAIN)
            seq = Sequences(words.hashes)
            chosen = batch.column("chosen")
            number = np.diff(np.asarray(chosen.offsets).astype(np.int64))
            flat = chosen.flatten()
            text = np.repeat(np.arange(batch.num_rows), number)
            pos, least, most = (np.asarray(flat.field(name)).astype(np.int64) for name in ("pos", "least", "most"))
            each = most - least + 1
            row = np.repeat(np.arange(len(pos)), each)
            offset = np.arange(int(each.sum())) - np.repeat(offsets_of(each)[:-1], each) + least[row]
            start = words.offsets[:-1][text[row]] + pos[row] - offset
            for lo in range(0, max(len(row), 1), 1 << 18):
                r = pa.array(row[lo:lo + (1 << 18)])
                s = start[lo:lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [longs(seq.of(s, s + length)), flat.field("key").take(r), flat.field("around").take(r), flat.field("copies").take(r),
                     batch.column("doc_id").take(pa.array(text[row[lo:lo + (1 << 18)]])), pa.array(pos[row[lo:lo + (1 << 18)]] - offset[lo:lo + (1 << 18)], pa.int32()),
                     pa.array(offset[lo:lo + (1 << 18)], pa.int32())],
                    ["window", "key", "around", "copies", "doc_id", "start", "offset"])

    return run


def _ranges(length: int):
    """Union of windows, as [begin, end) word ranges, of each row's (pos, bits, dropped)."""
    def merge(starts: np.ndarray) -> list[list[int]]:
        if not len(starts):
            return []
        starts = np.unique(starts)
        cut = np.flatnonzero(starts[1:] > starts[:-1] + length)
        return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length], axis=1).tolist()

    def of(pos: np.ndarray, bits: np.ndarray) -> np.ndarray:
        on = (bits[:, None] >> np.arange(length, dtype=np.int64)) & 1 == 1
        row, offset = np.nonzero(on)
        return pos[row] - offset

    def run(batches):
        for batch in batches:
            found = batch.column("found")
            bounds = np.asarray(found.offsets).astype(np.int64)
            bounds = bounds - (bounds[0] if len(bounds) else 0)
            flat = found.flatten()
            pos, bits, dropped = (np.asarray(flat.field(name)).astype(np.int64) for name in ("pos", "bits", "dropped"))
            rows = [(merge(of(pos[lo:hi], bits[lo:hi])), merge(of(pos[lo:hi], dropped[lo:hi]))) for lo, hi in zip(bounds[:-1], bounds[1:])]
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], ["doc_id", "passages", "drop"])

    return run


def _run_bits() -> Column:
    """One bit for each window offset from ``least`` to ``most``."""
    return F.expr("shiftleft(1L, most + 1) - shiftleft(1L, least + 0)")


def repeated_ranges(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, passages, drop``: word ranges [begin, end) of each document that holds a repeated passage.

    ``passages`` are the maximal ranges of words that lie in a repeated run of
    ``length`` words; ``drop`` those of them, or parts, that are not the first
    occurrence (smallest id, then place), which a deduplication takes out.
    Words are runs of anything but ASCII white space, compared as they stand.
    Documents without such a passage are not in the result, nor are null,
    empty and shorter texts.  Rows that repeat an id are one document, the one
    with the smallest text; rows with a null id take no part.
    """
    if not 0 < length - gram < 62 or gram < 1:
        raise ValueError("gram must be smaller than length, by less than 62 words")
    docs = one_row_per_id(df, id_col, text_col)
    suffixes = stored(docs.mapInArrow(_suffixes(length, gram), "key long, around long, doc_id long, pos int, least byte, most byte"), "suffixes")
    keys = suffixes.groupBy("key").agg(F.count("*").alias("n"), F.min("around").alias("x"), F.max("around").alias("y"))
    keys = stored(keys.where("n > 1").select("key", (F.col("x") != F.col("y")).alias("several")), "keys")
    shared = stored(suffixes.join(keys, "key"), "shared")
    # one suffix for each neighbourhood, the first in the corpus
    classes = shared.groupBy("key", "around").agg(
        F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("copies"), F.first("least").alias("least"),
        F.first("most").alias("most"), F.first("several").alias("several"))
    classes = stored(classes.select("key", "around", "first.*", "copies", "least", "most", "several"), "classes")
    run_bits = _run_bits()
    single = classes.where("NOT several").select("key", "around", "doc_id", "pos", run_bits.alias("bits"), run_bits.alias("own"))

    chosen = classes.where("several").groupBy("doc_id").agg(
        F.collect_list(F.struct("key", "around", "pos", "least", "most", "copies")).alias("chosen"))
    chosen = stored(chosen, "chosen")
    windows = docs.join(chosen, "doc_id").select("doc_id", "text", "chosen").mapInArrow(
        _windows(length), "window long, key long, around long, copies long, doc_id long, start int, offset int")
    windows = stored(windows, "windows")
    counted = windows.groupBy("window").agg(F.sum("copies").alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
    counted = stored(counted.where("n > 1").select("window", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start")), "counted")
    bit = F.expr("shiftleft(1L, offset)")
    mine = (F.col("doc_id") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    several = windows.join(counted, "window").groupBy("key", "around").agg(
        F.bit_or(bit).alias("bits"), F.bit_or(F.when(mine, bit).otherwise(F.lit(0).cast("long"))).alias("own"))
    several = classes.where("several").join(several, ["key", "around"]).select("key", "around", "doc_id", "pos", "bits", "own")
    marked = stored(single.unionByName(several).select(
        "key", "around", F.struct("doc_id", "pos").alias("first"), "bits", "own"), "marked")

    found = shared.select("key", "around", "doc_id", "pos").join(marked, ["key", "around"])
    dropped = F.when(F.col("first") == F.struct("doc_id", "pos"), F.col("bits").bitwiseAND(F.bitwise_not("own"))).otherwise(F.col("bits"))
    # a document's list has an entry for each of its own suffixes at most
    rows = found.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "bits", dropped.alias("dropped"))).alias("found"))
    return rows.mapInArrow(_ranges(length), "doc_id long, passages array<array<int>>, drop array<array<int>>")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each repeated passage: ``doc_id, first_word, n_words, n_dropped``; see :func:`repeated_ranges`."""
    rows = repeated_ranges(df, id_col, text_col, length, gram)
    out = rows.select("doc_id", "drop", F.explode("passages").alias("p"))
    begin, end = F.col("p")[0], F.col("p")[1]
    cut = F.aggregate("drop", F.lit(0), lambda s, d: s + F.greatest(F.lit(0), F.least(d[1], end) - F.greatest(d[0], begin)))
    return out.select("doc_id", begin.alias("first_word"), (end - begin).alias("n_words"), cut.alias("n_dropped"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_slices(batches, "text", HASH_BYTES):
        words = hash_words(batch.column("text"), PLAIN)
        out = []
        for i in range(batch.num_rows):
            text = (batch.column("text")[i].as_py() or "").encode()
            begin, end = words.begin[words.offsets[i]:words.offsets[i + 1]], words.end[words.offsets[i]:words.offsets[i + 1]]
            parts, at = [], 0
            for lo, hi in batch.column("drop")[i].as_py():
                parts.append(text[at:begin[lo]])
                at = int(begin[hi]) if hi < len(begin) else len(text)
            out.append(b"".join([*parts, text[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "kept_text"])


def deduplicated_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, kept_text`` of each document that loses words: its text without the ranges to drop.

    The words that stay keep the white space before them; a document that is
    all repeated has what is left, at worst the empty text.
    """
    ranges = repeated_ranges(df, id_col, text_col, length, gram).where(F.size("drop") > 0).select("doc_id", "drop")
    docs = one_row_per_id(df, id_col, text_col)
    return docs.join(stored(ranges, "ranges"), "doc_id").mapInArrow(_cut, "doc_id long, kept_text string")
