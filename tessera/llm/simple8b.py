"""Simple-8b word-aligned coding of unsigned integers, in numpy.

A 64-bit word holds a 4-bit selector (top) and 60 bits of payload; the
selector says how many values of which width the payload packs, lowest bits
first.  Selector 0 is the escape: its payload is an index into a list of raw
64-bit values, for values that need more than 60 bits.  Values are cut into
blocks of ``BLOCK``; the words of a block begin at a stored offset, so blocks
are encoded in lockstep, and any block can be decoded without those before it.

Layout, little-endian: ``b"TS8B"``, u32 block size, u64 number of values,
u32 number of blocks, u32 number of escapes, u32[blocks + 1] word offsets,
(padding to 8 bytes), u64 words, u64 escapes.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
MAGIC = b"TS8B"
#: Fixed values of the code: (values, bits) of selectors 1 to 14.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
             (2, 30), (1, 60)]
COUNTS = np.array([1, *(c for c, _ in SELECTORS), 0], np.int64)


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    v = np.ascontiguousarray(values).astype(np.uint64)
    n = len(v)
    blocks = -(-n // block)
    starts = np.arange(blocks, dtype=np.int64) * block
    top = int(v.max()) if n else 0
    # for each position, the selector that packs most values from there on; 0 where none fits
    index = np.int32 if n < 1 << 30 else np.int64
    pos = np.arange(n, dtype=index)
    limit = np.minimum((pos // index(block) + index(1)) * index(block), index(n))
    small = v.astype(np.uint32) if top < 1 << 32 else v
    choice = np.zeros(n, np.int8)
    for s, (count, bits) in enumerate(SELECTORS, 1):
        if top < 1 << bits:
            choice[choice == 0] = s
            break
        narrow = small < small.dtype.type(1 << bits)
        if 4 * np.count_nonzero(narrow) < n:
            # few values fit: only their runs are looked at
            held = np.flatnonzero(narrow)
            tail = np.append(np.flatnonzero(held[1:] != held[:-1] + 1), len(held) - 1) if len(held) else held
            first = np.repeat(held[tail] + 1, np.diff(tail, prepend=-1))
            held = held[first >= np.minimum(held + count, limit[held])]
            choice[held[choice[held] == 0]] = s
            continue
        first = np.minimum.accumulate(np.where(narrow, index(n), pos)[::-1])[::-1]
        fits = first >= np.minimum(pos + index(count), limit)
        fits &= choice == 0
        choice[fits] = s
    # walk all blocks side by side, one word a step
    at, stop, seen = starts.copy(), np.minimum(starts + block, n), []
    while len(at):
        seen.append(at)
        at = at + COUNTS[choice[at]]
        more = at < stop
        at, stop = at[more], stop[more]
    at = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
    picked = choice[at].astype(np.int64) if n else np.zeros(0, np.int64)
    words = picked.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(picked == s)
        if not len(rows):
            continue
        place, part = at[rows], np.zeros(len(rows), np.uint64)
        end = limit[place]
        for k in range(count):
            value = v[np.minimum(place, n - 1)] << np.uint64(k * bits)
            value[place >= end] = 0
            part |= value
            place += 1
        words[rows] |= part
    escaped = np.flatnonzero(picked == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(at, np.append(starts, n)).astype("<u4")
    head = MAGIC + struct.pack("<IQII", block, n, blocks, len(escaped)) + offsets.tobytes()
    head += b"\0" * (-len(head) % 8)
    return head + words.astype("<u8").tobytes() + v[at[escaped]].astype("<u8").tobytes()


def decode(data: bytes) -> np.ndarray:
    """All values, uint64."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    block, n, blocks, escapes = struct.unpack_from("<IQII", data, 4)
    offsets = np.frombuffer(data, "<u4", blocks + 1, 24).astype(np.int64)
    begin = 24 + 4 * (blocks + 1)
    begin += -begin % 8
    words = np.frombuffer(data, "<u8", int(offsets[-1]), begin)
    raw = np.frombuffer(data, "<u8", escapes, begin + 8 * len(words))
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    before = np.zeros(len(words) + 1, np.int64)
    np.cumsum(COUNTS[selector], out=before[1:])
    of_block = np.repeat(np.arange(blocks), offsets[1:] - offsets[:-1])
    at = of_block * block + before[:-1] - before[offsets[:-1]][of_block]
    stop = np.minimum((of_block + 1) * block, n)
    for s, (count, bits) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(selector == s)
        if not len(rows):
            continue
        part = (words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        index = at[rows][:, None] + np.arange(count)
        inside = index < stop[rows][:, None]
        out[index[inside]] = part[inside]
    rows = np.flatnonzero(selector == 0)
    out[at[rows]] = raw[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out
