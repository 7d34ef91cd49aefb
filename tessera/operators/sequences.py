"""Edit distances and n-gram counts of whole Arrow batches, as numpy arrays inside a task.

Texts come as ragged integer sequences: ``codes`` of all words (or code points) of a batch
and ``offsets`` at which each text begins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Symbols of a machine word; shorter sides up to that are measured without a band.
WORD_BITS = 64
#: Edits up to which pairs are tried first (fewer for short ones), and pairs at a time.
EDITS, PAIRS = 128, 1 << 13
#: Band that longer pairs are tried in, side by side; a distance within it is exact.
BAND = 128
#: Symbols of the texts that step side by side, and entries of a table of their (row, symbol) pairs, at most.
STEP_SYMBOLS, TABLE = 1 << 21, 1 << 22
#: The longest so many pairs of a group are measured one by one: steps that few texts take cost more than they save.
FEW = 24


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def _places_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat places of ``lengths`` symbols from each start on."""
    begin = np.repeat(starts - offsets_of(lengths)[:-1], lengths)
    return begin + np.arange(len(begin))


def coded(*columns: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, offsets) of list columns; equal strings of any column have one code, a null list is empty."""
    flat = [c.flatten().cast(pa.string()) for c in columns]
    codes = np.asarray(pa.concat_arrays(flat).dictionary_encode().indices.fill_null(-1)).astype(np.int64)
    out, at = [], 0
    for c, values in zip(columns, flat):
        lengths = np.asarray(pc.fill_null(pc.list_value_length(c), 0)).astype(np.int64)
        out.append((codes[at:at + len(values)], offsets_of(lengths)))
        at += len(values)
    return out


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance of two integer sequences, bit-parallel.

    The vertical differences of a column of the distance table are bits of two integers
    as long as the longer sequence, so a symbol of the shorter one costs a few
    operations on whole integers instead of one a cell.
    """
    n = min(len(a), len(b))
    same = a[:n] != b[:n]
    head = int(same.argmax()) if same.any() else n
    a, b = a[head:], b[head:]
    n -= head
    same = a[len(a) - n:] != b[len(b) - n:]
    tail = int(same[::-1].argmax()) if same.any() else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    m = len(a)
    if not len(b):
        return m
    order = np.argsort(a, kind="stable")
    wanted, text = np.unique(b, return_inverse=True)
    lo, hi = np.searchsorted(a[order], wanted), np.searchsorted(a[order], wanted, "right")
    masks = []
    for x, y in zip(lo.tolist(), hi.tolist()):
        bits = np.zeros(m, np.uint8)
        bits[order[x:y]] = 1
        masks.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little") if y > x else 0)
    full, top = (1 << m) - 1, m - 1
    plus, minus, score = full, 0, m
    for c in text.tolist():
        eq = masks[c]
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        score += (up >> top & 1) - (down >> top & 1)
        up = up << 1 | 1
        plus = (down << 1 | ~(xv | up)) & full
        minus = up & xv & full
    return score


def _trimmed(x, xo, xn, y, yo, yn):
    """Starts and lengths without the symbols that both have in common at either end."""
    n = np.minimum(xn, yn)
    offsets = offsets_of(n)
    rows = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(rows)) - offsets[rows]

    def first(differ: np.ndarray) -> np.ndarray:
        out = n.copy()
        some = n > 0
        if some.any():
            out[some] = np.minimum.reduceat(np.where(differ, within, n[rows]), offsets[:-1][some])
        return out

    head = first(x[xo[rows] + within] != y[yo[rows] + within])
    tail = first(x[(xo + xn)[rows] - 1 - within] != y[(yo + yn)[rows] - 1 - within])
    tail = np.minimum(tail, n - head)
    return xo + head, xn - head - tail, yo + head, yn - head - tail


def _numbers(keys: np.ndarray, asked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers from 1 of the distinct ``keys`` below ``size``, those of ``asked`` (0: none of the keys), and how many there are."""
    if size <= TABLE:
        table = np.zeros(size, np.int32)
        table[keys] = 1
        table *= np.cumsum(table, dtype=np.int32)
        return table[keys], table[asked], int(table.max(initial=0))
    distinct, number = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(distinct, asked), len(distinct) - 1)
    return number + 1, np.where(distinct[at] == asked, at + 1, 0), len(distinct)


def _packed(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """For each place the symbols from there on, as many as 64 bits hold, lowest bits first; and the bits of a symbol."""
    bits = 8 if codes.max() < 1 << 8 else 16 if codes.max() < 1 << 16 else 32
    out = codes.astype(np.uint64)
    for i in range(1, 64 // bits):
        out[:-i] |= codes[i:].astype(np.uint64) << np.uint64(i * bits)
    return out, bits


def _few_edits(packed: np.ndarray, bits: int, p_at: np.ndarray, p_n: np.ndarray, t_at: np.ndarray, t_n: np.ndarray) -> np.ndarray:
    """Edit distances up to ``EDITS`` and three times the root of the text's length, -1 for larger ones, of patterns and texts given by first place and length.

    For each number of edits and each diagonal (text place minus pattern place): how far into the
    pattern so many edits lead.  A pair takes work by the square of its edits, not by its length.
    """
    out, per = np.full(len(p_n), -1, np.int64), 64 // bits
    none, one, shift = -(1 << 30), np.uint64(1), np.uint64(bits.bit_length() - 1)
    rows, p_n, t_n = np.arange(len(p_n)), p_n.astype(np.int32), t_n.astype(np.int32)
    reach = np.full((len(p_n), 2 * EDITS + 3), none, np.int32)
    reach[:, EDITS + 1] = 0  # the pairs are trimmed: nothing matches without an edit
    for edits in range(1, EDITS + 1):
        lo, hi = EDITS + 1 - edits, EDITS + 2 + edits
        k = np.arange(-edits, edits + 1, dtype=np.int32)
        at = np.maximum(reach[:, lo:hi] + 1, reach[:, lo - 1:hi - 1])
        np.maximum(at, reach[:, lo + 1:hi + 1] + 1, out=at)
        end = np.minimum(p_n[:, None], t_n[:, None] - k)
        np.minimum(at, end, out=at)
        at[(at < 0) | (at + k < 0)] = none
        flat, left = at.reshape(-1), np.where(at >= 0, end - at, 0).reshape(-1)
        todo = np.flatnonzero(left > 0)
        left, row, col = left[todo], todo // len(k), todo % len(k)
        a = p_at[row] + flat[todo]
        b = t_at[row] + flat[todo] + k[col]
        while len(todo):
            differ = packed[a] ^ packed[b]
            same = np.minimum((np.bitwise_count((differ & (~differ + one)) - one) >> shift).astype(np.int64), left)
            flat[todo] += same
            on = np.flatnonzero((same == per) & (left > per))
            todo, a, b, left = todo[on], a[on] + per, b[on] + per, left[on] - per
        reach[:, lo:hi] = at
        goal = np.minimum(t_n - p_n, EDITS + 1) + EDITS + 1
        going = reach[np.arange(len(rows)), goal] < p_n
        out[rows[~going & (out[rows] < 0)]] = edits
        going &= t_n > edits * edits // 9  # beyond that the steps of the text are less work
        if not going.any():
            break
        if going.sum() > 0.8 * len(rows):
            continue
        rows, reach, p_at, p_n, t_at, t_n = rows[going], reach[going], p_at[going], p_n[going], t_at[going], t_n[going]
    return out


def _side_by_side(p: np.ndarray, p_n: np.ndarray, t: np.ndarray, t_n: np.ndarray, band: int) -> np.ndarray:
    """Edit distances of patterns ``p`` (flat symbols from 0, lengths) and texts ``t``, the longest text first, no pattern longer than its text.

    A step takes the next symbol of every text that goes on.  Of each pattern it works on the words of 64
    symbols that lie within ``band`` of the diagonal only.  Cells outside count as if each were
    one edit more than its neighbour, so no result is too small, and one of at most ``band`` is exact.
    """
    n_rows, width = len(p_n), 1 + int(max(p.max(), t.max()))
    p_row, t_row = np.repeat(np.arange(n_rows), p_n), np.repeat(np.arange(n_rows), t_n)
    place, asked, n_keys = _numbers(p_row * width + p, t_row * width + t, n_rows * width)
    within = np.arange(len(p)) - offsets_of(p_n)[p_row]
    longest = int(p_n.max())
    n_words = (longest - 1) // WORD_BITS + 1
    masks = np.zeros((n_words, n_keys + 1), np.uint64)  # where each pattern holds a symbol
    np.add.at(masks.reshape(-1), (within >> 6) * (n_keys + 1) + place, np.uint64(1) << (within & 63).astype(np.uint64))
    going = np.searchsorted(-t_n, -np.arange(int(t_n[0])))  # texts longer than j are the first ones
    start = offsets_of(going)
    step = np.empty(len(t), np.int32)
    step[start[np.arange(len(t)) - offsets_of(t_n)[t_row]] + t_row] = asked
    plus, minus = np.full((n_words, n_rows), ~np.uint64(0)), np.zeros((n_words, n_rows), np.uint64)
    one, top = np.uint64(1), np.uint64(WORD_BITS - 1)
    for j, k in enumerate(going.tolist()):
        symbols = step[start[j]:start[j] + k]
        more, less = one, np.uint64(0)  # difference along the row above the band
        for w in range(max(0, j - band) >> 6, (min(j + band, longest - 1) >> 6) + 1):
            eq, pv, mv = masks[w].take(symbols), plus[w, :k], minus[w, :k]
            xv = eq | mv
            eq |= less
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            down = pv & xh
            xh |= pv
            up = np.invert(xh, out=xh)
            up |= mv
            next_more, next_less = up >> top, down >> top
            up <<= one
            up |= more
            down <<= one
            down |= less
            np.bitwise_and(up, xv, out=mv)
            xv |= up
            np.invert(xv, out=xv)
            np.bitwise_or(down, xv, out=pv)
            more, less = next_more, next_less
    # a word that the band or the text has left keeps its last differences: together they lead to the last cell
    score = t_n.copy()
    for w in range(n_words):
        bits = np.clip(p_n - w * WORD_BITS, 0, WORD_BITS).astype(np.uint64)
        inside = np.where(bits > 0, ~np.uint64(0) >> (np.uint64(WORD_BITS) - np.maximum(bits, one)), np.uint64(0))
        score += np.bitwise_count(plus[w] & inside).astype(np.int64) - np.bitwise_count(minus[w] & inside).astype(np.int64)
    return score


def distances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Levenshtein distance of each pair of texts.

    What both have in common at either end goes first.  Pairs that are few edits apart take
    work by their edits.  The others step side by side, one symbol of the longer rest at a time: those whose
    shorter rest fits a machine word as they are, longer ones in a band.  What is still
    open, and the longest few, are measured one by one with long integers.  Exact for all lengths.
    """
    (x, xo), (y, yo) = a, b
    xs, xn, ys, yn = _trimmed(x, xo[:-1], np.diff(xo), y, yo[:-1], np.diff(yo))
    out = np.maximum(xn, yn)
    short, long = np.minimum(xn, yn), out.copy()
    open_ = short > 0
    if not open_.any():
        return out
    both = np.concatenate([x, y])
    both = both - both.min()
    both = _numbers(both, both, int(both.max()) + 1)[0] - 1
    swap = xn > yn  # the shorter side is the pattern
    p_at, t_at = np.where(swap, ys + len(x), xs), np.where(swap, xs, ys + len(x))
    packed, bits = _packed(both)
    todo = np.flatnonzero(open_ & (long - short <= EDITS))
    for rows in np.split(todo, range(PAIRS, len(todo), PAIRS)):
        found = _few_edits(packed, bits, p_at[rows], short[rows], t_at[rows], long[rows])
        sure = rows[found >= 0]
        out[sure] = found[found >= 0]
        open_[sure] = False
    for least, most, band in ((0, WORD_BITS, int(long.max())), (WORD_BITS, int(short.max()), BAND)):
        todo = np.flatnonzero(open_ & (short > least) & (short <= most) & (long - short <= band))
        todo = todo[np.argsort(-long[todo], kind="stable")][FEW:]
        part = np.cumsum(long[todo]) // STEP_SYMBOLS
        for rows in np.split(todo, np.flatnonzero(np.diff(part)) + 1):
            if not len(rows):
                continue
            p, t = both[_places_of(p_at[rows], short[rows])], both[_places_of(t_at[rows], long[rows])]
            found = _side_by_side(p, short[rows], t, long[rows], band)
            sure = rows[found <= band]
            out[sure] = found[found <= band]
            open_[sure] = False
    for i in np.flatnonzero(open_).tolist():
        out[i] = edit_distance(x[xs[i]:xs[i] + xn[i]], y[ys[i]:ys[i] + yn[i]])
    return out


def _counted(rows: np.ndarray, grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(rows * width + grams, return_counts=True)


def ngram_matches(hyp: tuple[np.ndarray, np.ndarray], refs: list[tuple[np.ndarray, np.ndarray]], n_max: int) -> tuple[np.ndarray, np.ndarray]:
    """Clipped and total n-gram counts of each row, one column a length; counts of several references are the largest.

    n-grams are numbered exactly: the number of one of n words is that of the pair of its first
    n - 1 words and its last.
    """
    texts = [hyp, *refs]
    n_rows = len(hyp[1]) - 1
    codes = np.concatenate([c for c, _ in texts])
    rows = np.concatenate([np.repeat(np.arange(n_rows), np.diff(o)) for _, o in texts])
    side = np.concatenate([np.full(len(c), i) for i, (c, _) in enumerate(texts)])
    left = np.concatenate([np.repeat(o[1:], np.diff(o)) - np.arange(len(c)) for c, o in texts])  # words from here to the end
    clipped, total = np.zeros((n_rows, n_max), np.int64), np.zeros((n_rows, n_max), np.int64)
    at, grams = np.arange(len(codes)), codes
    for n in range(1, n_max + 1):
        if n > 1:
            going = left[at] >= n
            at, grams = at[going], grams[going]
            grams = pd.factorize(grams << 32 | codes[at + n - 1])[0].astype(np.int64)
        width = int(grams.max()) + 1 if len(grams) else 1
        mine = side[at] == 0
        keys, counts = _counted(rows[at[mine]], grams[mine], width)
        total[:, n - 1] = np.bincount(rows[at[mine]], minlength=n_rows)
        found = [_counted(rows[at[s]], grams[s], width) for i in range(1, len(texts)) for s in [side[at] == i]]
        theirs, most = found[0]
        if len(found) > 1:
            theirs, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            most = np.zeros(len(theirs), np.int64)
            np.maximum.at(most, inverse, np.concatenate([c for _, c in found]))
        if len(theirs) and len(keys):
            place = np.minimum(np.searchsorted(theirs, keys), len(theirs) - 1)
            both = np.where(theirs[place] == keys, np.minimum(counts, most[place]), 0)
            clipped[:, n - 1] = np.bincount(keys // width, both, n_rows).astype(np.int64)
    return clipped, total
