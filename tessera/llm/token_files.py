"""Token-id files: whole corpora as packed ids in ascending document order.

``write_token_files`` encodes texts with the tokenizers library (its BPE model
gets each distinct piece of a slice once, and few that an earlier slice had), orders documents over the cluster by range, and writes
segments of Simple-8b blocks.  The container is Parquet, so that Spark's
committer makes the files whole when tasks are lost or repeated; each row is a
segment: ``shard`` (the range, ascending), ``first`` (ids before it in its
shard), ``n_ids``, the ids and lengths of its documents, and the payload.
``read_token_files`` unpacks the segments again, block-parallel.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from tessera.llm import simple8b
from tessera.llm.bpe_codec import BpeModel, byte_symbols, default_path
from tessera.llm.ragged import group_rows, offsets_of, row_slices, split_words, string_bytes, take
from tessera.llm.shared import shared_dir

END_ID = 1
#: Ids in a segment, about; a longer document has a segment of its own.
SEGMENT = 1 << 20
SCHEMA = ("shard int, first long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary")


#: Words, and pieces, whose ids a worker keeps from one slice, and task, to the next (affects speed only).
KEPT = 1 << 19


#: UTF-32 of the symbol for each byte.
SYMBOLS = np.array([ord(c) for c in byte_symbols()], "<u4")


class Kept:
    """Ids of the first ``KEPT`` distinct strings that a worker meets."""

    def __init__(self, kind: pa.DataType):
        self.items = pa.array([], kind)
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, items: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of the distinct ``items``, flat, and offsets; ``encode`` gets those that are not kept."""
        n = len(self.items)
        place = np.array(pc.fill_null(pc.index_in(items, value_set=self.items), -1), np.int64)
        fresh = np.flatnonzero(place < 0)
        new = items.take(pa.array(fresh))
        ids, offsets = encode(new)
        place[fresh] = n + np.arange(len(fresh))
        every = np.concatenate([self.ids, ids]), np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        room = min(KEPT - n, len(fresh))
        if room > 0:
            self.items = pa.concat_arrays([self.items, new[:room]])
            self.ids, self.offsets = every[0][:every[1][n + room]], every[1][:n + room + 1]
        return take(*every, place)


class LibraryModel(BpeModel):
    """The words' preparation of the codec, and the library's own BPE model for all new pieces of a slice in one call.

    Pieces come to the library's model as one text with spaces between them (no symbol of a byte is
    white space).  The last id of a piece, and no other, stands for a string with the end-of-word mark.
    """

    def __init__(self, path: str):
        super().__init__(path)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.words, self.pieces = Kept(pa.string()), Kept(pa.binary())
        closing = np.zeros(self.size, bool)
        closing[self.last] = True
        for right, made in zip(self.right.tolist(), self.product.tolist()):
            closing[made] = closing[right]
        self.closing = closing

    def _encode_pieces(self, pieces: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        data, offsets = string_bytes(pieces)
        text = np.insert(SYMBOLS[data], offsets[1:-1], np.uint32(0x20)).tobytes().decode("utf-32-le")
        # without the places in the text, which cost as much as the merges
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the ids do not end where the pieces do")
        return ids, np.concatenate([[0], ends])

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        return self.pieces.encode(pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers), self._encode_pieces)

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct word (no white space inside): flat ids and offsets."""
        return self.words.encode(words, super().encode_words)


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> LibraryModel:
    return LibraryModel(path)


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    model, shard, first = _tokenizer(path), TaskContext.get().partitionId(), 0
    for batch in row_slices(batches, "text"):
        codes, starts, words = split_words(batch.column("text"))
        ids, id_offsets = model.encode_words(words)
        # one more word, the end of a document, after each text
        ids = np.append(ids, np.int32(end_id))
        id_offsets = np.append(id_offsets, len(ids))
        codes = np.insert(codes, starts[1:], len(words))
        starts = starts + np.arange(len(starts))
        ends = offsets_of((id_offsets[1:] - id_offsets[:-1])[codes])[starts]
        for lo, hi in group_rows(ends, SEGMENT):
            out, _ = take(ids, id_offsets, codes[starts[lo]:starts[hi]])
            lengths = (ends[lo + 1:hi + 1] - ends[lo:hi]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([len(out)], pa.int64()),
                pa.array([batch.column("doc_id").slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int32())), pa.array([simple8b.encode(out)], pa.binary())],
                ["shard", "first", "n_ids", "doc_ids", "lengths", "payload"])
            first += len(out)


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending id order.

    A null text is empty and has the end id alone; a null document id sorts
    first.  Repeated rows are all written, in a fixed order.  An empty table
    writes an empty folder.  ``shards`` is the number of ranges (by default
    ``spark.sql.shuffle.partitions``).
    """
    tokenizer = tokenizer or default_path()
    named = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = named.repartitionByRange(shards, *order) if shards else named.repartitionByRange(*order)
    rows = ranged.sortWithinPartitions(*order).mapInArrow(lambda it: _segments(it, tokenizer, end_id), SCHEMA)
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def _read_segments(batches: Iterator[pa.RecordBatch], give) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            lengths = np.asarray(row.column("lengths").flatten()).astype(np.int64)
            ids = simple8b.decode(row.column("payload")[0].as_py())
            offsets = offsets_of(lengths)
            yield give(row.column("doc_ids").flatten(), row.column("start")[0].as_py() + offsets, ids, offsets)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``, the ids of all documents before them."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # one row for each range that was written, so the table is small and its order needs one task
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(base), "shard").select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "lengths", "payload")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids array<long>`` of every document in the files."""

    def give(doc_ids, starts, ids, offsets):
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int64)))
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(starts[:-1]), lists], ["doc_id", "start", "ids"])

    return _placed(spark, path).mapInArrow(lambda it: _read_segments(it, give), "doc_id long, start long, ids array<long>")


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def give(doc_ids, starts, ids, offsets):
        raw = memoryview(ids.astype("<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(starts[:-1]), pa.array(offsets[1:] - offsets[:-1]), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, path).mapInArrow(
        lambda it: _read_segments(it, give), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write all texts to files in the shared folder and return the digests read back from them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/token_ids"
    write_token_files(df, path, id_col, text_col, tokenizer)
    return token_file_digests(spark, path)
