"""Numpy and Arrow helpers for columns of words inside one task.

Nothing here touches Spark: the functions work on the Arrow batches that a
task is handed, and their memory is bounded by the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step inside a task works on at a time.
SLICE_BYTES = 8 << 20


def release() -> None:
    """Give freed memory back: an idle worker otherwise keeps the most that it ever had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def plain_text(column: pa.Array) -> pa.StringArray:
    """The column as an Arrow string array; null becomes the empty text."""
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def row_slices(batches: Iterator[pa.RecordBatch], text: str,
               max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``max_bytes`` of text (at least one row)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)
                release()


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text.

    Returns ``codes`` (an index into the distinct words for every word, in
    text order), ``offsets`` (where each text's codes begin; one more than
    the texts) and the distinct words.
    """
    lists = pc.ascii_split_whitespace(plain_text(column))
    bounds = np.asarray(lists.offsets).astype(np.int64)
    words = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    full = np.asarray(pc.binary_length(words)) > 0
    before = offsets_of(full)
    words = words.filter(pa.array(full))
    coded = words.dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int32)
    return codes, before[bounds - bounds[0]], coded.dictionary.cast(pa.string())


def take(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the ragged rows ``index`` of (values, offsets)."""
    lengths = (offsets[1:] - offsets[:-1])[index]
    out = offsets_of(lengths)
    at = np.repeat(offsets[:-1][index] - out[:-1], lengths)
    at += np.arange(out[-1])
    return values[at], out


def group_rows(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges that hold about ``most`` elements each (at least one row)."""
    n = len(offsets) - 1
    part = (offsets[1:] - offsets[0]) // max(most, 1)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]


def string_bytes(array: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array without nulls."""
    array = pa.concat_arrays([array])
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    if array.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (uint64 in, uint64 out)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
