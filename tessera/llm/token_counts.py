"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes the longest piece at each place.  The
automaton is a trie over all pieces with failure links: where no longer piece
goes on, the link leads to the state after the pieces that are then certain,
and how many those are is stored with it.  Each byte moves the automaton
forward once, no piece is built, and nothing is read twice.  A task steps all
distinct words of a slice side by side, byte by byte.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe_codec import byte_symbols
from tessera.llm.ragged import offsets_of, row_slices, split_words, string_bytes

TOKENIZER = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class LongestMatch:
    """Failure-link trie over pieces that begin a word and pieces that go on in it."""

    def __init__(self, begin: list[bytes], inside: list[bytes]):
        edges: dict[int, int] = {}
        is_piece = [False, False]
        parent, label, depth = [-1, -1], [0, 0], [0, 0]
        for root, pieces in ((0, begin), (1, inside)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    child = edges.get(key)
                    if child is None:
                        child = edges[key] = len(is_piece)
                        is_piece.append(False)
                        parent.append(node)
                        label.append(byte)
                        depth.append(depth[node] + 1)
                    node = child
                if node > 1:
                    is_piece[node] = True
        n = len(is_piece)
        fail, popped = [-1] * n, [0] * n
        for v in sorted(range(2, n), key=depth.__getitem__):
            if is_piece[v]:
                fail[v], popped[v] = 1, 1
                continue
            u, byte = parent[v], label[v]
            z, count = fail[u], popped[u]
            while z >= 0 and (z << 8 | byte) not in edges:
                count += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = edges[z << 8 | byte], count
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.child = np.fromiter(edges.values(), np.int32, len(edges))[order]
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int64)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], -1) if len(self.keys) else np.full(len(state), -1, np.int32)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pieces in each word; -1 where the pieces cannot spell it."""
        lengths = offsets[1:] - offsets[:-1]
        order = np.argsort(-lengths, kind="stable")
        start, length = offsets[:-1][order], lengths[order]
        state = np.zeros(len(order), np.int32)
        count = np.zeros(len(order), np.int64)
        dead = np.zeros(len(order), bool)
        for t in range(int(length[0]) if len(length) else 0):
            going = int(np.searchsorted(-length, -t, side="left"))  # words longer than t
            at = np.flatnonzero(~dead[:going])
            byte = data[start[at] + t].astype(np.int64)
            while len(at):
                to = self._step(state[at], byte)
                found = to >= 0
                state[at[found]] = to[found]
                at, byte = at[~found], byte[~found]
                count[at] += self.popped[state[at]]
                state[at] = self.fail[state[at]]
                lost = state[at] < 0
                dead[at[lost]] = True
                at, byte = at[~lost], byte[~lost]
        at = np.flatnonzero(~dead & (length > 0))
        while len(at):
            at = at[state[at] != 1]
            count[at] += self.popped[state[at]]
            state[at] = self.fail[state[at]]
            lost = state[at] < 0
            dead[at[lost]] = True
            at = at[~lost]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(dead, -1, count)
        return out


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> LongestMatch:
    """Pieces of a byte-level vocabulary: those with a leading space begin a word, the others go on in it."""
    spec = json.load(open(path, encoding="utf-8"))
    special = {t["content"] for t in spec["added_tokens"]}
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    pieces = [bytes(byte_of[c] for c in name) for name in spec["model"]["vocab"] if name not in special]
    return LongestMatch([p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "])


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 automaton: LongestMatch | None = None, lead: bytes = b" ") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every whole text.

    Words are runs of anything but ASCII white space; ``lead`` is put before
    each (the word-begin mark of the vocabulary).  A word that the pieces
    cannot spell is one token and counts as unknown.  A null or empty text has
    zero of each; repeated rows and rows without an id stay.  An empty table gives an empty
    one; other columns are ignored, whatever their names.
    """
    path = path or default_path()
    named = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton or load_vocabulary(path)
        for batch in row_slices(batches, "text"):
            codes, starts, words = split_words(batch.column("text"))
            data, offsets = string_bytes(words)
            if lead:
                data = np.insert(data, np.repeat(offsets[:-1], len(lead)), np.tile(np.frombuffer(lead, np.uint8), len(words)))
                offsets = offsets + len(lead) * np.arange(len(offsets))
            count = match.counts(data, offsets)
            unknown = count < 0
            tokens = offsets_of(np.where(unknown, 1, count)[codes])
            missing = offsets_of(unknown[codes])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x[starts[1:]] - x[starts[:-1]], pa.int64())
                                           for x in (np.arange(len(codes) + 1), tokens, missing))],
                ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return named.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
