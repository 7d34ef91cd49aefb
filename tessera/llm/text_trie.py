"""A compressed (radix) trie over whole texts, with the smallest id at each terminal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class _Node:
    __slots__ = ("edges", "least", "rows")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, _Node]] = {}  # first byte -> label, child
        self.least: int | None = None                    # smallest id of the text that ends here
        self.rows: list | None = None


def _agree(a: bytes, b: bytes, at: int) -> int:
    """Bytes that ``a`` and ``b[at:]`` have in common at their beginning."""
    n = min(len(a), len(b) - at)
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n, at)
    return int(differ.argmax()) if n and differ.any() else n


class TextTrie:
    """Texts as bytes; each edge holds the run of bytes up to the next branch or end of a text."""

    def __init__(self):
        self.root = _Node()
        self.size = 0

    def insert(self, text: bytes, number: int, row) -> None:
        """Put ``row`` at the end of ``text`` and lower the smallest id there to ``number``."""
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                end = _Node()
                node.edges[text[at]] = (text[at:], end)
                self.size += len(text) - at
                node = end
                break
            label, child = edge
            if text.startswith(label, at):
                node = child
                at += len(label)
                continue
            k = _agree(label, text, at)
            middle = _Node()
            middle.edges[label[k]] = (label[k:], child)
            node.edges[text[at]] = (label[:k], middle)
            node = middle
            at += k
        if node.rows is None:
            node.rows = []
        node.rows.append(row)
        if node.least is None or number < node.least:
            node.least = number

    def terminals(self) -> Iterator[tuple[int, list]]:
        """Smallest id and rows of each text."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.rows is not None:
                yield node.least, node.rows
            stack.extend(child for _, child in node.edges.values())
