"""Vocabularies, encode and decode.

A vocabulary is a DataFrame ``(piece STRING, id INT, freq BIGINT, kind STRING)``
whose size is bounded by the ``vocab_size`` the caller asks for; that bound is
what allows it to be broadcast into the encode and decode joins.  Broadcast
joins also make a hot word ("the" may be several percent of all tokens)
harmless: no partition is keyed by word.

Encoding works on each row where it is, in an Arrow function with the vocabulary as a
dictionary.  Vocabularies too large for that, and rows that share a key, take
explode -> join -> regroup by row key.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tessera.config import SPECIAL_PIECES, UNK_ID, WORD_MARK
from tessera.operators.ordering import exact_rank
from tessera.functions.text import chars, marked_words, nfkc, split_white_space, split_words
from tessera.session import scratch_path

VOCAB_SCHEMA = StructType(
    [
        StructField("piece", StringType(), False),
        StructField("id", IntegerType(), False),
        StructField("freq", LongType(), True),
        StructField("kind", StringType(), False),
    ]
)

# A broadcast side must stay below this many rows (the vocabulary bound).
MAX_BROADCAST_VOCAB = 2_000_000
# Pieces that every Python worker may hold as a dictionary, and repeated keys that may be broadcast.
MAX_ROWWISE_VOCAB, MAX_REPEATED_KEYS = 1 << 18, 1 << 20


def specials_df(spark: SparkSession, specials=SPECIAL_PIECES) -> DataFrame:
    """The special pieces at their fixed ids 0..len-1."""
    rows = [(p, i, None, "special") for i, p in enumerate(specials)]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def word_counts(df: DataFrame, col: str, marked: bool = False, apply_nfkc: bool = False) -> DataFrame:
    """``(word, freq)`` over whitespace words; partial + final aggregate.

    ``marked`` prefixes each word with the word-start mark (subword training).
    ``apply_nfkc`` normalises after counting: each distinct raw word is
    normalised once (Python, non-ASCII words only), split again (NFKC can
    produce spaces) and the counts are re-aggregated -- the same result as
    normalising every text first, without sending the corpus through Python.
    """
    raw = df.select(F.explode(split_words(col)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    if apply_nfkc:
        parts = F.when(F.col("word").rlike(r"^[\x00-\x7F]*$"), F.array("word")).otherwise(split_words(nfkc("word")))
        raw = raw.select(F.explode(parts).alias("word"), "freq").groupBy("word").agg(F.sum("freq").alias("freq"))
    if marked:
        raw = raw.select(F.concat(F.lit(WORD_MARK), F.col("word")).alias("word"), "freq")
    return raw


def char_inventory(wc: DataFrame, coverage: float = 1.0, word_col: str = "word", freq_col: str = "freq") -> DataFrame:
    """``(ch, freq)`` weighted by word frequency; with ``coverage < 1``
    keep the most frequent characters until that share of all characters is
    covered.  The running sum runs over the alphabet only (bounded by the
    number of distinct characters)."""
    inv = (
        wc.select(F.explode(chars(word_col)).alias("ch"), F.col(freq_col).alias("w"))
        .groupBy("ch")
        .agg(F.sum("w").cast("bigint").alias("freq"))
    )
    if coverage >= 1.0:
        return inv
    w = Window.orderBy(F.desc("freq"), F.asc("ch")).rowsBetween(Window.unboundedPreceding, -1)
    tot = Window.partitionBy(F.lit(0))
    return (
        inv.withColumn("_before", F.coalesce(F.sum("freq").over(w), F.lit(0)))
        .withColumn("_all", F.sum("freq").over(tot))
        .where(F.col("_before") < F.lit(float(coverage)) * F.col("_all"))
        .drop("_before", "_all")
    )


def frequency_floor(counts: DataFrame, k: int, freq_col: str = "freq"):
    """The smallest frequency a top-``k`` piece can have.

    Reads a histogram ``freq -> number of pieces`` from the top until it
    covers ``k`` pieces; at most ``k`` histogram rows reach the driver.
    Returns None when the table has fewer than ``k`` pieces."""
    hist = (
        counts.groupBy(freq_col).agg(F.count(F.lit(1)).alias("_pieces"))
        .orderBy(F.desc(freq_col)).limit(int(k)).collect()
    )
    covered = 0
    for row in hist:
        covered += row["_pieces"]
        if covered >= k:
            return row[freq_col]
    return None


def top_pieces(counts: DataFrame, k: int | None, piece_col: str = "word", freq_col: str = "freq",
               first_id: int = len(SPECIAL_PIECES), kind: str = "word",
               exclude=SPECIAL_PIECES) -> DataFrame:
    """The ``k`` most frequent pieces, ids from ``first_id`` in (freq desc, piece) order.

    A frequency floor (see :func:`frequency_floor`) first drops every piece
    that cannot be in the top ``k``, so the final ``orderBy().limit(k)`` --
    whose last step runs in one task -- sees about ``k`` rows plus ties
    instead of ``k`` rows from every partition.  ``k=None`` ranks every row:
    only for tables bounded by construction (an alphabet).
    """
    top = counts.where(~F.col(piece_col).isin(list(exclude)))
    if k is not None:
        k = max(int(k), 0)
        floor = frequency_floor(top, k, freq_col) if k > 0 else None
        if floor is not None:
            top = top.where(F.col(freq_col) >= F.lit(floor))
        top = top.orderBy(F.desc(freq_col), F.asc(piece_col)).limit(k)
    w = Window.orderBy(F.desc(freq_col), F.asc(piece_col))
    return top.select(
        F.col(piece_col).alias("piece"),
        (F.row_number().over(w) - 1 + F.lit(first_id)).cast("int").alias("id"),
        F.col(freq_col).cast("bigint").alias("freq"),
        F.lit(kind).alias("kind"),
    )


def with_specials(body: DataFrame, specials=SPECIAL_PIECES) -> DataFrame:
    """Specials at ids 0..6 followed by the learned pieces."""
    sp = specials_df(body.sparkSession, specials)
    return sp.unionByName(body.select(*VOCAB_SCHEMA.fieldNames()))


#: Buckets a shuffle partition, and sampled rows a bucket, of an equi-depth cut.
BUCKETS, SAMPLED = 4, 64


def _assign(splitters: list[bytes]):
    @F.arrow_udf(IntegerType())
    def bucket(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_right(splitters, k) for k in keys.to_pylist()], pa.int32())

    return bucket


def depth_buckets(df: DataFrame, key: str, out_col: str = "_bucket") -> DataFrame:
    """Order-preserving buckets of about equal size on a unique binary key.

    The splitters are quantiles of the rows whose hash is divisible by a step: the same rows whenever
    it is computed, at most about ``2 * SAMPLED`` a bucket on the driver, however
    many rows there are and whatever prefix they share.
    """
    buckets = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    step = max(1, df.count() // (SAMPLED * buckets))
    sample = sorted(bytes(r[0]) for r in df.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(key).collect())
    splitters = [sample[len(sample) * i // buckets] for i in range(1, buckets)] if sample else []
    return df.withColumn(out_col, _assign(splitters)(F.col(key)))


def all_pieces(counts: DataFrame, piece_col: str = "word", freq_col: str = "freq",
               first_id: int = len(SPECIAL_PIECES), kind: str = "word", exclude=SPECIAL_PIECES) -> DataFrame:
    """Every piece, ids from ``first_id`` in (freq desc, piece) order, for vocabularies that grow with the data.

    The rank is put together from equi-depth buckets of that order (see :func:`depth_buckets`), so
    it does not matter that most words are rare or begin alike; there are as many
    offsets as buckets.  The counts are written once, as they are read three times.
    """
    path = scratch_path(counts.sparkSession, "piece-counts")
    key = F.concat(F.unhex(F.lpad(F.hex(F.lit((1 << 63) - 1) - F.col(freq_col)), 16, "0")), F.col(piece_col).cast("binary"))
    counts.where(~F.col(piece_col).isin(list(exclude))).withColumn("_key", key).write.parquet(path)
    d = depth_buckets(counts.sparkSession.read.parquet(path), "_key")
    ranked = exact_rank(d, ["_key"], ["_bucket"], rank_col="_rank", broadcast_offsets=False)
    return ranked.select(
        F.col(piece_col).alias("piece"), (F.col("_rank") + F.lit(first_id)).cast("int").alias("id"),
        F.col(freq_col).cast("bigint").alias("freq"), F.lit(kind).alias("kind"))


def fit_word_vocab(df: DataFrame, col: str, vocab_size: int | None, apply_nfkc: bool = False) -> DataFrame:
    """T11 word tokenizer: specials + the ``vocab_size - 7`` most frequent words (all words for None)."""
    wc = word_counts(df, col, apply_nfkc=apply_nfkc)
    if vocab_size is None:
        return with_specials(all_pieces(wc))
    return with_specials(top_pieces(wc, vocab_size - len(SPECIAL_PIECES)))


def fit_char_vocab(df: DataFrame, col: str, vocab_size: int, coverage: float = 1.0) -> DataFrame:
    """T11 character tokenizer: specials + the most frequent characters."""
    inv = char_inventory(word_counts(df, col), coverage)
    return with_specials(top_pieces(inv, vocab_size - len(SPECIAL_PIECES), piece_col="ch", kind="char"))


def vocab_size(vocab: DataFrame) -> DataFrame:
    """The vocabulary size as a one-row table."""
    return vocab.agg(F.count(F.lit(1)).cast("bigint").alias("vocab_size"))


def _bounded_broadcast(vocab: DataFrame, max_rows: int | None = MAX_BROADCAST_VOCAB):
    """Broadcast a vocabulary after checking its size.

    Vocabularies are bounded by ``vocab_size``, but a caller can pass any
    table: it is counted once (and kept, so the join does not recompute it)
    and only broadcast when it has at most ``max_rows`` rows.  Larger tables
    take a shuffle join, where AQE splits a skewed piece key."""
    if not max_rows:
        return vocab
    kept = vocab.persist()
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def checked_rows(table: DataFrame, max_rows: int = MAX_BROADCAST_VOCAB, what: str = "table") -> int:
    """Count a table that is about to be shipped whole (driver dict or
    broadcast) and refuse it above ``max_rows``."""
    n = table.count()
    if n > max_rows:
        raise ValueError(f"{what} has {n} rows; at most {max_rows} may be broadcast")
    return n


def piece_to_id(df: DataFrame, vocab: DataFrame, piece_col: str = "piece", id_col: str = "id",
                unk_id: int = UNK_ID) -> DataFrame:
    """Left join to the vocabulary; an unknown piece maps to ``<unk>`` (0)."""
    v = _bounded_broadcast(vocab.select(F.col("piece").alias("_p"), F.col("id").alias("_id")))
    return df.join(v, F.col(piece_col) == F.col("_p"), "left").select(
        *df.columns, F.coalesce(F.col("_id"), F.lit(unk_id)).cast("int").alias(id_col)
    )


def id_to_piece(df: DataFrame, vocab: DataFrame, id_col: str = "id", piece_col: str = "piece") -> DataFrame:
    """T7 inverse: id to piece (NULL when the id is outside the vocabulary)."""
    v = _bounded_broadcast(vocab.select(F.col("id").alias("_id"), F.col("piece").alias("_p")))
    return df.join(v, F.col(id_col) == F.col("_id"), "left").select(*df.columns, F.col("_p").alias(piece_col))


def _tagger(side: int):
    def tag(w, i):
        return F.struct(F.lit(side).alias("side"), i.alias("pos"), w.alias("piece"))

    return tag


def char_units(col):
    """Characters of the text's words (whitespace is not a unit)."""
    return F.flatten(F.transform(split_words(col), lambda w: F.split(w, "")))


def _encode_joined(df: DataFrame, key: str, specs: list, unk_id: int, marked: bool, unit: str) -> DataFrame:
    """Units meet the vocabularies in a join and are regrouped by ``key``."""
    parts = []
    vocabs = None
    for side, (text_col, _out, vocab) in enumerate(specs):
        if unit == "char":
            words = char_units(text_col)
        else:
            words = marked_words(text_col, apply_nfkc=False) if marked else split_words(text_col)
        parts.append(
            F.coalesce(
                F.transform(words, _tagger(side)),
                F.array().cast("array<struct<side:int,pos:int,piece:string>>"),
            )
        )
        v = vocab.select(F.lit(side).alias("_side"), F.col("piece").alias("_p"), F.col("id").alias("_id"))
        vocabs = v if vocabs is None else vocabs.unionByName(v)
    toks = df.select(F.col(key).alias("_k"), F.inline(F.concat(*parts)))
    looked = toks.join(
        _bounded_broadcast(vocabs), (F.col("side") == F.col("_side")) & (F.col("piece") == F.col("_p")), "left"
    ).select("_k", "side", "pos", F.coalesce(F.col("_id"), F.lit(unk_id)).cast("int").alias("id"))
    aggs = []
    for side, (_t, out_col, _v) in enumerate(specs):
        lst = F.collect_list(F.when(F.col("side") == side, F.struct("pos", "id")))
        aggs.append(F.transform(F.array_sort(lst), lambda x: x["id"]).alias(f"_ids{side}"))
    grouped = looked.groupBy("_k").agg(*aggs)
    out = df.join(grouped, F.col(key) == F.col("_k"), "left")
    cols = [F.col(c) for c in df.columns]
    for side, (text_col, out_col, _v) in enumerate(specs):
        cols.append(
            F.when(F.col(text_col).isNull(), F.lit(None).cast("array<int>"))
            .otherwise(F.coalesce(F.col(f"_ids{side}"), F.array().cast("array<int>")))
            .alias(out_col)
        )
    return out.select(*cols)


def piece_dictionary(vocab: DataFrame):
    """``piece -> id`` sent to the workers, or None for more than ``MAX_ROWWISE_VOCAB`` pieces or repeated ones."""
    rows = vocab.select("piece", "id").where(F.col("piece").isNotNull()).limit(MAX_ROWWISE_VOCAB + 1).collect()
    ids = {r["piece"]: r["id"] for r in rows}
    if len(rows) > MAX_ROWWISE_VOCAB or len(ids) < len(rows):
        return None
    return vocab.sparkSession.sparkContext.broadcast({p: int(i) for p, i in ids.items() if i is not None})


def _row_ids(b_ids: Broadcast, unk_id: int, marked: bool, unit: str):
    mark = WORD_MARK if marked and unit == "word" else ""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        known, flat, ends = b_ids.value, array("i"), [0]
        for t in texts.to_pylist():
            if t is not None:
                words = split_white_space(t)
                units = "".join(words) if unit == "char" else [mark + w for w in words] if mark else words
                flat.extend([known.get(u, unk_id) for u in units])
            ends.append(len(flat))
        none = pa.array(np.asarray(texts.is_null())) if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)), mask=none)

    return ids


def encode_words(df: DataFrame, key: str, specs: list, unk_id: int = UNK_ID, marked: bool = False,
                 unit: str = "word") -> DataFrame:
    """T11 encode for one or more text columns in one pass.

    ``specs`` is a list of ``(text_col, out_col, vocab)``.  Each text is split
    into units -- whitespace words (``marked`` adds the word-start mark) or,
    with ``unit="char"``, the characters of those words -- looked up in its
    vocabulary (unknown -> ``<unk>``) in order.  NULL text gives
    NULL ids, empty text ``[]``; so does a NULL key.  ``vocab`` may come with its dictionary, as a
    pair with what :func:`piece_dictionary` gives.

    Rows are encoded where they are.  Rows that repeat a key have the ids of all of
    them, so those alone are regrouped by the key; so is everything when a
    vocabulary is too large for a dictionary in each worker.
    """
    given = [v if isinstance(v, tuple) else (v, piece_dictionary(v)) for _, _, v in specs]
    plain = [(text_col, out_col, v) for (text_col, out_col, _), (v, _) in zip(specs, given)]
    if any(b is None for _, b in given):
        return _encode_joined(df, key, plain, unk_id, marked, unit)
    repeated = df.select(F.col(key).alias("_dk")).where("_dk IS NOT NULL").groupBy("_dk").count().where("count > 1").select("_dk")
    n = repeated.limit(MAX_REPEATED_KEYS + 1).count()
    if n > MAX_REPEATED_KEYS:
        return _encode_joined(df, key, plain, unk_id, marked, unit)
    same = F.col(key) == F.col("_dk")
    once = df.join(F.broadcast(repeated), same, "left_anti") if n else df
    empty = F.array().cast("array<int>")
    ids = [
        F.when(F.col(text_col).isNotNull() & F.col(key).isNull(), empty).otherwise(_row_ids(b, unk_id, marked, unit)(F.col(text_col))).alias(out_col)
        for (text_col, out_col, _), (_, b) in zip(specs, given)
    ]
    out = once.select(*[F.col(c) for c in df.columns], *ids)
    if not n:
        return out
    return out.unionByName(_encode_joined(df.join(F.broadcast(repeated), same, "left_semi"), key, plain, unk_id, marked, unit))


def decode_ids(df: DataFrame, key: str, ids_col: str, vocab: DataFrame, out_col: str = "text",
               mode: str = "word") -> DataFrame:
    """Ids to text.  ``word`` joins pieces with spaces; ``subword``
    concatenates pieces and turns the word-start mark into a space, then
    trims.  Specials decode to their literal piece text (``strip_specials``
    first to avoid that)."""
    toks = df.select(F.col(key).alias("_k"), F.posexplode(ids_col).alias("pos", "_tid"))
    v = _bounded_broadcast(vocab.select(F.col("id").alias("_vid"), F.col("piece").alias("_p")))
    looked = toks.join(v, F.col("_tid") == F.col("_vid"), "left").select(
        "_k", "pos", F.coalesce(F.col("_p"), F.lit("")).alias("_p")
    )
    sep = " " if mode == "word" else ""
    grouped = looked.groupBy("_k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_p"))), lambda x: x["_p"]), sep).alias("_txt")
    )
    out = df.join(grouped, F.col(key) == F.col("_k"), "left")
    txt = F.when(F.col(ids_col).isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(F.col("_txt"), F.lit("")))
    if mode != "word":
        txt = F.trim(F.replace(txt, F.lit(WORD_MARK), F.lit(" ")))
    return out.select(*[F.col(c) for c in df.columns], txt.alias(out_col))
