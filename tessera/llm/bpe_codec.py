"""BPE encoding and decoding with a pair occurrence index.

A task splits its texts into words, keeps each distinct word once, and lays
their symbols out in one array with links to the neighbours.  An index maps
every pair that has a rank to all its positions.  Ranks are applied in
ascending order: all positions of the pair are merged together, and the pairs
that this makes are entered under their own, higher ranks.  The token ids of a
text are then gathered from those of its words, so a word is merged once per
slice of a partition, however often it occurs.

Results equal those of the public tokenizers library for a BPE file with byte
symbols, an end-of-word mark, lower-casing and white space dropped.  A word
never spans white space, so encoding words apart changes nothing; characters
outside the Latin blocks go through the file's own normaliser and
pre-tokeniser, one distinct word at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ragged import SLICE_BYTES, group_rows, offsets_of, row_slices, split_words, string_bytes, take

TOKENIZER = "word_bpe_49k.json"
#: Elements that a gather over the texts of a slice makes at a time.
GATHER = 1 << 20
#: Words of other characters are prepared by the tokenizer file's own rules.
OTHER_CHARACTERS = r"[^!-~\x{A1}-\x{24F}]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {}, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class BpeModel:
    """Merge table, byte symbols and decoding table of a tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("ignore_merges"):
            raise ValueError("the file must hold a BPE model with the word end </w>")
        self.path = path
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.specials.values()])
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.symbol_byte = {c: b for b, c in enumerate(symbols)}
        self.inner = np.array([vocab[c] for c in symbols], np.int32)
        self.last = np.array([vocab[c + end] for c in symbols], np.int32)
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.product = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._check_order()
        keys = self.left.astype(np.int64) * self.size + self.right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        # byte symbols are few: their pairs have a table of their own
        base = np.concatenate([self.inner, self.last])
        self.small = np.full(self.size, 512, np.int32)
        self.small[base] = np.arange(512)
        table = self._search(np.repeat(base, 512), np.tile(base, 512))
        self.small_rank = np.full((513, 513), -1, np.int32)
        self.small_rank[:512, :512] = table.reshape(512, 512)
        names = [""] * self.size
        for name, i in [*vocab.items(), *self.specials.items()]:
            names[i] = name
        self.names, self.name_offsets = string_bytes(pa.array([n + " " for n in names], pa.string()))
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def _check_order(self) -> None:
        """A sweep in rank order is right if a merge only makes pairs of higher rank."""
        if len(np.unique(self.product)) != len(self.product):
            raise ValueError("two merges make the same symbol")
        made = np.full(self.size, -1, np.int64)
        made[self.product] = np.arange(len(self.product))
        ranks = np.arange(len(self.product))
        if (made[self.left] >= ranks).any() or (made[self.right] >= ranks).any():
            raise ValueError("a merge uses a symbol that a later merge makes")

    def _search(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.by_key[at], -1).astype(np.int32)

    # -- words to pieces ------------------------------------------------------

    @property
    def library(self):
        from tokenizers import Tokenizer

        if not hasattr(self, "_library"):
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _pieces(self, words: list[str], other: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        """Pre-tokenised pieces of the words, and the word each belongs to."""
        plain = ["" if o else w for w, o in zip(words, other)]
        found = PIECES.findall("\n".join(plain).lower()) if plain else []
        pieces = pa.array(found, pa.string())
        breaks = np.asarray(pc.equal(pieces, "\n")) if found else np.zeros(0, bool)
        owner = np.cumsum(breaks)[~breaks]
        pieces = pieces.filter(pa.array(~breaks))
        more, more_owner = [], []
        tok = self.library if other.any() else None
        for i in np.flatnonzero(other):
            text = tok.normalizer.normalize_str(words[i])
            for piece, _ in tok.pre_tokenizer.pre_tokenize_str(text):
                more.append(bytes(self.symbol_byte[c] for c in piece))
                more_owner.append(i)
        if more:
            pieces = pa.concat_arrays([pieces.cast(pa.binary()), pa.array(more, pa.binary())])
            owner = np.concatenate([owner, np.array(more_owner, np.int64)])
            order = np.argsort(owner, kind="stable")
            pieces, owner = pieces.take(pa.array(order)), owner[order]
        return pieces.cast(pa.binary()), owner

    def _whole_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that hold no special token."""
        array = pa.array(words, pa.string())
        other = np.asarray(pc.match_substring_regex(array, OTHER_CHARACTERS)) if words else np.zeros(0, bool)
        pieces, owner = self._pieces(words, other)
        coded = pieces.dictionary_encode()
        data, offsets = string_bytes(coded.dictionary)
        ids, id_offsets = self.merge(data, offsets)
        ids, ends = take(ids, id_offsets, np.asarray(coded.indices))
        counts = np.bincount(owner, weights=ends[1:] - ends[:-1], minlength=len(words)) if len(owner) else np.zeros(len(words))
        return ids, offsets_of(counts.astype(np.int64))

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each word (no white space inside): flat ids and offsets."""
        has = np.zeros(len(words), bool)
        for special in self.specials:
            has |= np.asarray(pc.match_substring(words, special))
        items = words.to_pylist()
        if not has.any():
            return self._whole_words(items)
        # split the words that hold special tokens; each part is a word of its own
        parts, owner, fixed = [], [], []
        for i, word in enumerate(items):
            for part in self.special_split.split(word) if has[i] else [word]:
                if part or not has[i]:
                    special = self.specials.get(part, -1) if has[i] else -1
                    parts.append("" if special >= 0 else part)
                    owner.append(i)
                    fixed.append(special)
        ids, offsets = self._whole_words(parts)
        fixed = np.array(fixed)
        lengths = np.where(fixed >= 0, 1, offsets[1:] - offsets[:-1])
        out_offsets = offsets_of(lengths)
        out = np.empty(out_offsets[-1], np.int32)
        is_special = np.zeros(len(out), bool)
        is_special[out_offsets[:-1][fixed >= 0]] = True
        out[is_special] = fixed[fixed >= 0]
        out[~is_special] = ids
        per_word = np.bincount(np.array(owner), weights=lengths, minlength=len(items)).astype(np.int64)
        return out, offsets_of(per_word)

    # -- merges ---------------------------------------------------------------

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge byte pieces with the occurrence index; flat ids and offsets."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        # position n is a wall: its symbol pairs with nothing
        sym = np.empty(n + 1, np.int32)
        sym[:n] = self.inner[data]
        sym[n] = -1
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        sym[ends] = self.last[data[ends]]
        nxt = np.arange(1, n + 2, dtype=np.int32)
        nxt[ends] = n
        nxt[n] = n
        prv = np.arange(-1, n, dtype=np.int32)
        starts = offsets[:-1][offsets[1:] > offsets[:-1]]
        prv[starts] = n
        prv[n] = n

        small = self.small[sym[:n]]
        right = np.append(small, 512)[nxt[:n]]
        first = self.small_rank[small, right]
        at = np.flatnonzero(first >= 0)
        order = np.argsort(first[at].astype(np.uint16) if len(self.product) < 65536 else first[at], kind="stable")
        at = at[order].astype(np.int32)
        bounds = np.searchsorted(first[at], np.arange(len(self.product) + 1))
        later: dict[int, list[np.ndarray]] = {}

        for rank in range(len(self.product)):
            lo, hi = bounds[rank], bounds[rank + 1]
            lists = later.pop(rank, None)
            if lists is None:
                if lo == hi:
                    continue
                pos = at[lo:hi]
            else:
                pos = np.concatenate([at[lo:hi], *lists]) if lo < hi or len(lists) > 1 else lists[0]
            a, b, made = self.left[rank], self.right[rank], self.product[rank]
            follow = nxt[pos]
            ok = (sym[pos] == a) & (sym[follow] == b)
            if not ok.all():
                pos, follow = pos[ok], follow[ok]
                if not len(pos):
                    continue
            if a == b and len(pos) > 1:
                pos, follow = _alternate(pos, follow)
            beyond = nxt[follow]
            sym[pos] = made
            sym[follow] = -2
            nxt[pos] = beyond
            prv[beyond] = pos
            prv[n] = n
            before = prv[pos]
            before = before[(before != n) & (sym[before] != made)]
            touched = np.concatenate([pos, before])
            new = self._search(sym[touched], sym[nxt[touched]])
            keep = new >= 0
            if not keep.any():
                continue
            touched, new = touched[keep], new[keep]
            if len(new) == 1:
                later.setdefault(int(new[0]), []).append(touched)
                continue
            order = np.argsort(new)
            touched, new = touched[order], new[order]
            cut = np.flatnonzero(new[1:] != new[:-1]) + 1
            begin = [0, *cut.tolist()]
            for r, lo_, hi_ in zip(new[begin].tolist(), begin, [*begin[1:], len(new)]):
                later.setdefault(r, []).append(touched[lo_:hi_])

        alive = sym[:n] >= 0
        count = offsets_of(alive)
        return sym[:n][alive], count[offsets]

    # -- texts ----------------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the token names joined by spaces, each text with one space too many."""
        out, ends = take(self.names, self.name_offsets, ids)
        return out, ends[offsets]


#: The split rule of the tokenizer file, with a line feed between words.
PIECES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _alternate(pos: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of overlapping positions in a run of one symbol keep the 1st, 3rd, ... of the run."""
    order = np.argsort(pos)
    pos, follow = pos[order], follow[order]
    chained = np.concatenate([[False], pos[1:] == follow[:-1]])
    index = np.arange(len(pos))
    run = np.maximum.accumulate(np.where(chained, 0, index))
    keep = (index - run) % 2 == 0
    return pos[keep], follow[keep]


@lru_cache(maxsize=4)
def load_model(path: str) -> BpeModel:
    return BpeModel(path)


def _encoded(batches: Iterator[pa.RecordBatch], model: BpeModel) -> Iterator[tuple]:
    """(rows, ids, offsets) for consecutive rows of each slice."""
    for batch in row_slices(batches, "text", SLICE_BYTES // 2):
        codes, starts, words = split_words(batch.column("text"))
        ids, id_offsets = model.encode_words(words)
        lengths = (id_offsets[1:] - id_offsets[:-1])[codes]
        ends = offsets_of(lengths)[starts]
        for lo, hi in group_rows(ends, GATHER):
            out, word_ends = take(ids, id_offsets, codes[starts[lo]:starts[hi]])
            yield batch.slice(lo, hi - lo), out, word_ends[starts[lo:hi + 1] - starts[lo]]


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token ids of every text: ``doc_id, ids array<int>``; a null or empty text has no ids.

    Row for row: repeated rows stay, an empty table gives an empty one, other
    columns are left out, whatever their names.
    """
    path = path or default_path()

    def run(batches):
        model = load_model(path)
        for rows, ids, offsets in _encoded(batches, model):
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], ["doc_id", "ids"])

    return _named(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Text of id lists (special tokens kept): ``doc_id, text``; null lists give null.

    An id outside the vocabulary, or null, fails the job.
    """
    path = path or default_path()

    def run(batches):
        model = load_model(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("ids")
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            offsets = offsets_of(lengths)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("null token id")
            ids = np.asarray(flat).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= model.size):
                raise ValueError(f"token id outside 0..{model.size - 1}")
            absent = np.asarray(pc.is_null(lists))
            texts = []
            for lo, hi in group_rows(offsets, GATHER):
                data, ends = model.decode_bytes(ids[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                raw = data.tobytes()
                texts += [raw[s:max(s, e - 1)].decode("utf-8") for s, e in zip(ends[:-1], ends[1:])]
            texts = [None if gone else t for t, gone in zip(texts, absent)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    named = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return named.mapInArrow(run, "doc_id long, text string")


def round_trip_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode, decode again, and return a digest of each: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The ids are digested as little-endian unsigned 32-bit integers, the decoded
    text as UTF-8, both in lowercase hex.  A null text counts as empty.  With
    ``with_ids`` the ids themselves follow as ``ids array<int>``.  Every row has its own row in the
    result, repeated ones and those without an id too; an empty table gives an empty one, and other
    columns are ignored, whatever their names.
    """
    path = path or default_path()

    def run(batches):
        model = load_model(path)
        for rows, ids, offsets in _encoded(batches, model):
            raw = memoryview(ids.astype("<u4")).cast("B")
            id_sha = [hashlib.sha256(raw[4 * s:4 * e]).hexdigest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            data, ends = model.decode_bytes(ids, offsets)
            text = memoryview(np.ascontiguousarray(data))
            text_sha = [hashlib.sha256(text[s:max(s, e - 1)]).hexdigest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            columns = {"doc_id": rows.column("doc_id"), "n_tokens": pa.array(offsets[1:] - offsets[:-1], pa.int64()),
                       "ids_sha256": pa.array(id_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return _named(df, id_col, text_col).mapInArrow(run, schema)
