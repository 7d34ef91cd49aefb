"""Runs: stretches of words that repeat with a period, from an enhanced suffix array.

A run is a maximal stretch with smallest period ``q`` that is at least
``min_length`` words and ``exponent`` periods long.  For the texts of a slice
together (no two texts ever compare as equal):

1.  Suffixes are ranked by prefix doubling; only those that are still tied are
    sorted again.  A run shares ``min_length * (1 - 1 / exponent)`` words with
    itself one period on, so texts in which no two places share as many are done
    after a few rounds.
2.  The ranks give the suffix array, its inverse ``ISA`` and, compared level by
    level, the LCP table.  Each LCP interval is known by its nearest smaller
    neighbours; no tree is built.
3.  Branching-tandem test: in an interval of depth ``d``, for each suffix ``i`` in
    all children but the largest, ``ISA[i + d]`` and ``ISA[i - d]`` are looked up; if
    one is in the interval but in another child, a square of period ``d`` begins at
    ``i`` or ``i - d`` that cannot be moved on by a word.
4.  Squares are rotated to the left as far as the words allow (again by the ranks),
    and those that cover the same stretch are one run with the least period.

Everything is row-local: nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ragged import group_rows, offsets_of, row_slices, split_words
from tessera.llm.wordhash import HASH_BYTES

MIN_LENGTH = 24
EXPONENT = 3
#: Suffixes of smaller children looked up at a time.
LOOKED_UP = 1 << 21


def _doubled(codes: np.ndarray, text: np.ndarray, end: np.ndarray, rounds: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by (text, first 2**k words) for k = 0, 1, ..., and the places still tied in the last.

    The rank is the place that a group of ties begins at in the sorted order; equal
    ranks at level k mean 2**k equal words, as two places of a text never end together.
    """
    n = len(codes)
    key = text.astype(np.int64) << 32 | codes
    at = np.argsort(key, kind="stable")
    first, second = key[at], np.zeros(n, np.int64)
    base = np.zeros(n, np.int64)
    rank = np.zeros(n, np.int64)
    levels: list[np.ndarray] = []
    width = 1
    while True:
        # ``at`` is sorted by (first, second); the group of ``first`` begins at rank ``base``
        m = len(at)
        place = np.arange(m)
        parted = np.ones(m + 1, bool)
        parted[1:m] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        own = np.maximum.accumulate(np.where(parted[:m], place, 0))
        outer = np.ones(m, bool)
        outer[1:] = first[1:] != first[:-1]
        whole = np.maximum.accumulate(np.where(outer, place, 0)) if levels else np.zeros(m, np.int64)
        rank = rank.copy()
        rank[at] = base + own - whole
        levels.append(rank)
        at = at[~(parted[:m] & parted[1:])]
        if not len(at) or len(levels) == rounds:
            return levels, at
        on = at + width
        inside = on < end[at]
        second = np.where(inside, rank[np.minimum(on, n - 1)], -1)
        order = np.argsort(rank[at] * np.int64(n + 1) + second + 1, kind="stable")
        at, second = at[order], second[order]
        first = base = rank[at]
        width *= 2


def _nearest(lcp: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """Nearest place before (step -1) or after (1) with a smaller value, or a smaller or equal one.

    Pointers skip what is known to be larger, all places at a time; the ends hold -1.
    """
    to = np.clip(np.arange(len(lcp)) + step, 0, len(lcp) - 1)
    todo = np.flatnonzero(lcp > 0)
    while len(todo := todo[lcp[to[todo]] > lcp[todo] if equal else lcp[to[todo]] >= lcp[todo]]):
        to[todo] = to[to[todo]]
    return to


def _lcp(levels: list[np.ndarray], array: np.ndarray) -> np.ndarray:
    """Words in common of neighbours in the suffix array; -1 at both ends."""
    n = len(array)
    a, b = array[:-1].copy(), array[1:].copy()
    out = np.full(n + 1, -1, np.int64)
    out[1:n] = 0
    for k in range(len(levels) - 1, -1, -1):
        rank = np.append(levels[k], -1)
        same = np.flatnonzero(rank[a] == rank[b])
        a[same] += 1 << k
        b[same] += 1 << k
        out[1 + same] += 1 << k
    return out


def _branching(levels: list[np.ndarray], begin: np.ndarray, end: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and period of the squares that cannot be moved on by a word, among those that a run may end with."""
    isa = levels[-1]
    n = len(isa)
    array = np.empty(n, np.int64)
    array[isa] = np.arange(n)
    lcp = _lcp(levels, array)
    left, right = _nearest(lcp, -1, False), _nearest(lcp, 1, False)
    after, before = _nearest(lcp, 1, True), _nearest(lcp, -1, True)
    # a run has three places at least that share its period, and needs so many words
    j = np.flatnonzero(lcp > 0)
    depth = lcp[j]
    long = end[array[j]] - begin[array[j]]
    j = j[(right[j] - left[j] >= exponent) & (exponent * depth <= long)]
    head = j[lcp[before[j]] < lcp[j]]  # the first boundary of an interval also closes its first child
    owner = np.concatenate([j, head])
    lo = np.concatenate([j, left[head]])
    hi = np.concatenate([after[j], head])
    order = np.lexsort((hi - lo, lcp[owner], left[owner]))
    owner, lo, hi = owner[order], lo[order], hi[order]
    largest = np.ones(len(owner), bool)
    largest[:-1] = (left[owner[1:]] != left[owner[:-1]]) | (lcp[owner[1:]] != lcp[owner[:-1]])
    owner, lo, hi = owner[~largest], lo[~largest], hi[~largest]
    sizes = offsets_of(hi - lo)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c0, c1 in group_rows(sizes, LOOKED_UP):
        child = np.repeat(np.arange(c0, c1), (hi - lo)[c0:c1])
        i = array[lo[child] + np.arange(len(child)) + sizes[c0] - sizes[child]]
        d = lcp[owner[child]]
        for other, fits in ((i + d, i + d < end[i]), (i - d, i - d >= begin[i])):
            y = isa[np.clip(other, 0, n - 1)]
            hit = fits & (y >= left[owner[child]]) & (y < right[owner[child]]) & ((y < lo[child]) | (y >= hi[child]))
            starts.append(np.minimum(i, other)[hit])
            periods.append(d[hit])
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
    return both[0], both[1]


def find_runs(codes: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the ragged texts (codes, offsets): text, first word in it, length and period, by text, start, period."""
    shared = min_length - min_length // exponent
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)
    end = offsets[1:][text]
    nothing = (np.zeros(0, np.int64),) * 4
    if not len(codes):
        return nothing
    _, tied = _doubled(codes, text, end, max(1, shared.bit_length()))
    chosen = np.unique(text[tied])
    if not len(chosen):
        return nothing
    # the texts in which so many words come twice, by themselves
    keep = np.isin(text, chosen)
    codes, text = codes[keep], text[keep]
    bounds = offsets_of(lengths[chosen])
    row = np.repeat(np.arange(len(chosen)), lengths[chosen])
    begin, end = bounds[:-1][row], bounds[1:][row]
    levels, _ = _doubled(codes, row, end)
    start, period = _branching(levels, begin, end, exponent)
    stop = start + 2 * period
    ahead = start + period
    first = begin[start]
    for k in range(len(levels) - 1, -1, -1):
        w = 1 << k
        fits = np.flatnonzero(start - w >= first)
        same = fits[levels[k][start[fits] - w] == levels[k][ahead[fits] - w]]
        start[same] -= w
        ahead[same] -= w
    length = stop - start
    good = np.flatnonzero(length >= np.maximum(min_length, exponent * period))
    good = good[np.lexsort((period[good], stop[good], start[good]))]
    fresh = np.ones(len(good), bool)
    fresh[1:] = (start[good[1:]] != start[good[:-1]]) | (stop[good[1:]] != stop[good[:-1]])
    good = good[fresh]
    good = good[np.lexsort((period[good], start[good]))]
    return text[start[good]], start[good] - first[good], length[good], period[good]


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"


def _runs(min_length: int, exponent: int, rewrite):
    def run(batches):
        for batch in row_slices(batches, "text", HASH_BYTES):
            codes, offsets, words = split_words(batch.column("text"))
            if rewrite:
                codes = codes.copy()
                for i, number in enumerate(batch.column("doc_id").to_pylist()):
                    lo, hi = offsets[i], offsets[i + 1]
                    index = rewrite(number, int(hi - lo))
                    if index is not None:
                        codes[lo:hi] = codes[lo:hi][index]
            text, start, length, period = find_runs(codes, offsets, min_length, exponent)
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, offsets[:-1][text] + start + period, 1)
            np.add.at(change, offsets[:-1][text] + start + length, -1)
            kept = np.cumsum(change)[:-1] == 0
            lists = pa.ListArray.from_arrays(pa.array(offsets_of(kept)[offsets], pa.int32()), words.take(pa.array(codes[kept])))
            found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            ends = offsets_of(np.bincount(text, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found),
                 pc.binary_join(lists, " ")], ["doc_id", "n_words", "runs", "collapsed_text"])

    return run


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT,
                  rewrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed_text`` for every row.

    Words are runs of anything but ASCII white space.  ``runs`` lists ``start, length,
    period`` (in words, from 0) by start, then period; ``collapsed_text`` has the words
    that no run holds beyond its first period, joined by one space.  ``rewrite`` may
    name, from a row's id and number of words, the word that each place gets.
    Null and empty texts have no words, no runs and an empty ``collapsed_text``.
    Rows are judged one by one, so repeated rows, equal texts and null ids need no
    care; an empty table gives an empty one; other columns are ignored.
    """
    if min_length < 2 or exponent < 2:
        raise ValueError("a run has at least two words and two periods")
    named = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return named.mapInArrow(_runs(min_length, exponent, rewrite), RUNS)


def every_tenth_periodic(number: int | None, n: int) -> np.ndarray | None:
    """For ids whose crc32 is divisible by 10: from word ``a`` on, the ``p`` words there come again and again."""
    h = 1 if number is None else zlib.crc32(str(number).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def run_report(df: DataFrame) -> DataFrame:
    """Digests of :func:`periodic_runs`: the run of the greatest exponent, and hashes of all runs and of the collapsed text.

    Quotients of doubles order exponents exactly up to 2**26 words a text.
    """
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"] / r["period"]).alias("k"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return df.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))
