"""64-bit hashes of words and of word sequences, in numpy, for the slices a task works on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ragged import mix64, offsets_of, plain_text, string_bytes

#: Text bytes hashed at a time; about 30 bytes of memory for each.
HASH_BYTES = 4 << 20
_RNG = np.random.default_rng(64)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0] = 0
_PLACE = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]


def _table(separators: list[int], fold: bool) -> np.ndarray:
    """What each byte counts as in a word; 0 parts words."""
    t = np.arange(256, dtype=np.uint8)
    if fold:
        t[0x41:0x5B] += 32
    t[0] = 1  # a NUL is part of a word, like any other byte that is not white space
    t[separators] = 0
    return t


#: Words as they stand; with A-Z lower-cased; letters, digits and non-ASCII bytes only.
PLAIN = _table(SPACE, False)
LOWER = _table(SPACE, True)
ALNUM = _table([b for b in range(128) if not chr(b).isalnum()], True)


@dataclass
class Words:
    hashes: np.ndarray   # uint64, one a word
    offsets: np.ndarray  # where each text's words begin; one more than the texts
    begin: np.ndarray    # byte at which each word begins, within its text
    end: np.ndarray


def hash_words(column: pa.Array, table: np.ndarray) -> Words:
    data, bounds = string_bytes(plain_text(column))
    kind = table[data]
    inside = np.zeros(len(kind) + 1, bool)
    inside[:-1] = kind != 0
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    edges = bounds[:-1][bounds[1:] > bounds[:-1]]
    first[edges] = inside[edges]
    begin = np.flatnonzero(first)
    last = inside[:-1] & ~inside[1:]
    tails = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    last[tails] = inside[tails]
    end = np.flatnonzero(last) + 1
    offsets = np.searchsorted(begin, bounds)
    lengths = end - begin
    if len(begin):
        # each byte by its place in the word; what parts words adds nothing
        starts = (begin - begin[0]).astype(np.int32)
        size = len(kind) - int(begin[0])
        place = np.arange(size, dtype=np.int32)
        place -= np.repeat(starts, np.diff(np.append(starts, size)))
        value = _BYTE[kind[begin[0]:]]
        value *= _PLACE[place & 4095]
        if int(lengths.max()) > 4096:
            value *= ((place >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        hashes = mix64(np.add.reduceat(value, starts) + lengths.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    per_text = np.repeat(bounds[:-1], offsets[1:] - offsets[:-1])
    return Words(hashes, offsets, begin - per_text, end - per_text)


class Sequences:
    """Hashes of any runs of words in a slice."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        inverse = np.full(n + 1, _INVERSE, np.uint64)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.sums[stop] - self.sums[start]) * self.inverse[start]
        return mix64(raw + (stop - start).astype(np.uint64) * np.uint64(_BASE))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``size``-word shingles of each text; a shorter text is one shingle, one without words has none."""
    seq = Sequences(words.hashes)
    out, lengths = [], []
    if len(words.hashes) >= size:
        at = np.arange(len(words.hashes) - size + 1)
        grams = seq.of(at, at + size)
    for lo, hi in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        if hi - lo >= size:
            s = np.unique(grams[lo:hi - size + 1])
        elif hi > lo:
            s = seq.of(np.array([lo]), np.array([hi]))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
        lengths.append(len(s))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), offsets_of(np.array(lengths, np.int64))


def one_row_per_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` with each id once: rows that repeat an id are one document, the one with the smallest text."""
    named = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    named = named.where("doc_id IS NOT NULL")
    n, distinct = named.agg(F.count("*"), F.count_distinct("doc_id")).first()
    return named if n == distinct else named.groupBy("doc_id").agg(F.min("text").alias("text"))


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64), pa.int64())


def binary_lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
