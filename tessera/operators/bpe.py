"""Byte-pair-encoding vocabularies learned and applied as Spark jobs.

Training (T5) reads the corpus once (T2 word counts with the word-start
mark), then runs merge *rounds* over an index from pairs to the words that hold
them (:mod:`tessera.operators.bpe_index`).  A round guesses several merges, the words
that they touch report how all counts change at each step, and the driver, which
holds the best pairs, keeps the steps that a one-at-a-time learner would have taken.

Encoding (T9) works on each row where it is, in an Arrow function with the
merges broadcast (bounded by the vocabulary size) and a cache of words in each
task; a variant encodes distinct words, joins the pieces back and regroups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd

from tessera.config import SPECIAL_PIECES, UNK_ID, WORD_MARK
from tessera.functions.text import chars, marked_words, split_white_space
from tessera.operators import tokenizer as tok
from tessera.operators.bpe_index import PairIndex, WordTable, distinct_pairs, learn
from tessera.session import checkpoint_root, scratch_path

MERGES_SCHEMA = StructType(
    [
        StructField("rank", IntegerType(), False),
        StructField("left", StringType(), False),
        StructField("right", StringType(), False),
        StructField("n", LongType(), False),
    ]
)


#: Merges that are learned on the table of all words; later ones touch few words each and go by the pair index.
TABLE_MERGES = 2048


def symbols_of(word_col: str = "word"):
    """Initial symbols of a word: its characters (the mark is a character)."""
    return chars(word_col)


#: The specials that a text can hold as words; the others are control pieces.
SPECIAL_SET = frozenset(p for p in SPECIAL_PIECES if p.startswith("["))
LITERAL_SPECIALS = re.compile("(" + "|".join(re.escape(p) for p in sorted(SPECIAL_SET)) + ")")


def pair_counts(words: DataFrame, sym_col: str = "syms", freq_col: str = "freq") -> DataFrame:
    """T4: ``(left, right, n)``: adjacent symbol pairs weighted by word
    frequency.  A run of one symbol counts from left to right without overlap,
    as merging it would (``a a a a`` holds the pair twice)."""
    return pair_counts_joined(words.select(F.array_join(sym_col, " ").alias("_s"), F.col(freq_col).alias("_w")), "_s", "_w")


def pair_counts_joined(words: DataFrame, sym_col: str = "syms", freq_col: str = "freq") -> DataFrame:
    """T4 on space-joined symbol strings: JVM expressions yield the pairs; no lambda per pair."""
    return (
        words.select(F.explode(distinct_pairs(sym_col)).alias("_p"), F.col(freq_col).alias("_w"))
        .groupBy("_p")
        .agg(F.sum("_w").cast("bigint").alias("n"))
        .select(F.substring_index("_p", " ", 1).alias("left"), F.substring_index("_p", " ", -1).alias("right"), "n")
    )


def train_bpe(df: DataFrame, col: str, vocab_size: int, coverage: float = 1.0, max_candidates: int = 1024, compact_every: int = 32,
              exact: bool = True, apply_nfkc: bool = True, specials=SPECIAL_PIECES):
    """T5: learn merges until the vocabulary (specials + alphabet + merges)
    reaches ``vocab_size``.  Returns ``(vocab, merges, rounds)``; ``merges`` has the
    pair's count ``n`` when it was merged.

    The corpus is read once (word counts).  The first ``TABLE_MERGES`` merges are learned on a table of
    all distinct words; later rounds read and rewrite only the words that
    hold one of their pairs (:mod:`tessera.operators.bpe_index`).  The order is that of merging
    the best pair by (count descending, left, right) one at a time.
    ``exact=False`` takes all pairs of a round's guess without checking that
    each was the best (fewer rounds; merge order may differ near ties).
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    wc = tok.word_counts(df, col, marked=True, apply_nfkc=apply_nfkc)
    # no pair is counted inside or across a literal special, which is one piece
    parts = F.when(F.col("word").contains("["), F.split("word", LITERAL_SPECIALS.pattern.replace("(", "(?:", 1))).otherwise(F.array("word"))
    wc = wc.select(F.explode(parts).alias("word"), "freq").where("word <> ''").groupBy("word").agg(F.sum("freq").alias("freq"))
    words = wc.select("word", "freq", F.array_join(symbols_of("word"), " ").alias("syms")).checkpoint()
    alphabet = tok.char_inventory(words.select("word", "freq"), coverage)
    # the alphabet is bounded by the number of distinct characters
    alpha_vocab = tok.top_pieces(alphabet, None, piece_col="ch", first_id=len(specials), kind="char",
                                 exclude=specials).persist()  # small; lineage ends at the checkpointed words
    letters = {r["piece"] for r in alpha_vocab.select("piece").collect()}
    n_alpha = len(letters)
    n_merges = vocab_size - len(specials) - n_alpha
    if n_merges < 0:
        raise ValueError(f"vocab_size {vocab_size} cannot hold {len(specials)} specials and an alphabet of {n_alpha}")
    merges, rounds = [], 0
    if n_merges:
        table = WordTable(words)
        merges, rounds = learn(table, min(n_merges, TABLE_MERGES), letters, max_candidates, exact=exact)
        if len(merges) == TABLE_MERGES < n_merges:
            made = letters.union(left + right for left, right, _ in merges)
            more, further = learn(PairIndex(table.words(), compact_every), n_merges - TABLE_MERGES, made, max_candidates, exact=exact)
            merges, rounds = merges + more, rounds + further
    merge_rows = [(i, left, right, n) for i, (left, right, n) in enumerate(merges)]
    merges_df = spark.createDataFrame(merge_rows, MERGES_SCHEMA)
    first = len(specials) + n_alpha
    merged = merges_df.select(
        F.concat("left", "right").alias("piece"),
        (F.col("rank") + F.lit(first)).cast("int").alias("id"),
        F.lit(None).cast("bigint").alias("freq"),
        F.lit("merge").alias("kind"),
    )
    # the same string can come out of two different merges: keep its first
    # occurrence, then number densely (the table is bounded by vocab_size)
    merged = merged.withColumn("_r", F.row_number().over(Window.partitionBy("piece").orderBy("id"))).where("_r = 1").drop("_r")
    merged = merged.withColumn("id", (F.row_number().over(Window.orderBy("id")) - 1 + F.lit(first)).cast("int"))
    vocab = tok.with_specials(alpha_vocab.unionByName(merged), specials)
    return vocab, merges_df, rounds


def encode_word(word: str, ranks: dict, piece_ids: dict, unk_id: int = UNK_ID) -> list:
    """Pieces of one word by replaying merges in rank order (each merge joins
    every left-to-right occurrence), then piece ids (unknown -> ``<unk>``).

    The symbols are a linked list and the pairs that can merge wait in a heap by (rank,
    place), so a word of n characters takes n log n steps.  A merge makes only
    pairs that wait behind it: one whose rank has passed is not replayed.
    """
    syms = list(word)
    n = len(syms)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((syms[i], syms[i + 1]))) is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        if syms[i] is None or (j := after[i]) >= n or ranks.get((syms[i], syms[j])) != rank:
            continue  # one of the two has merged with another symbol since
        syms[i] += syms[j]
        syms[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((syms[i], syms[k]), -1)) > rank:
                heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((syms[h], syms[i]), -1)) > rank:
            heappush(heap, (r, h))
    return [piece_ids.get(s, unk_id) for s in syms if s is not None]


def encode_raw_word(marked: str, ranks: dict, piece_ids: dict, unk_id: int = UNK_ID, apply_nfkc: bool = True) -> list:
    """Ids of one marked raw word: NFKC first (it can turn one word into
    several, e.g. when a compatibility character expands to a space), then
    each resulting word is encoded with its own word-start mark; a literal
    special is one piece wherever it stands (B24)."""
    out: list = []
    for part in word_parts(marked, apply_nfkc):
        if part in SPECIAL_SET:
            out.append(piece_ids.get(part, unk_id))
        else:
            out.extend(encode_word(part, ranks, piece_ids, unk_id))
    return out


def _word_coder(b_ranks, b_ids, unk_id, apply_nfkc: bool = True):
    def run(batches):
        ranks, ids = b_ranks.value, b_ids.value
        for pdf in batches:
            pdf = pdf.copy()
            pdf["wids"] = [encode_raw_word(w, ranks, ids, unk_id, apply_nfkc) for w in pdf["word"]]
            yield pdf

    return run


def broadcast_model(spark: SparkSession, vocab: DataFrame, merges: DataFrame):
    """Merges and piece ids as driver dicts, broadcast to the workers.  Both
    are bounded by the vocabulary size; both are counted first."""
    tok.checked_rows(merges, what="merge table")
    tok.checked_rows(vocab, what="vocabulary")
    mr = {(r["left"], r["right"]): int(r["rank"]) for r in merges.collect()}
    ids = {r["piece"]: int(r["id"]) for r in vocab.collect()}
    sc = spark.sparkContext
    return sc.broadcast(mr), sc.broadcast(ids)


CACHED_WORDS = 1 << 18
HOT_WORDS = 10_000  # words joined by broadcast; every other word is rarer than the last of them


def _row_coder(b_ranks, b_ids, unk_id, apply_nfkc):
    @F.pandas_udf(ArrayType(IntegerType()))
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks, ids = b_ranks.value, b_ids.value

        @lru_cache(maxsize=CACHED_WORDS)  # one cache a task; results do not depend on it
        def word_ids(w: str) -> tuple:
            return tuple(encode_raw_word(WORD_MARK + w, ranks, ids, unk_id, apply_nfkc))

        for texts in batches:
            yield pd.Series([None if t is None else [i for w in split_white_space(t) for i in word_ids(w)] for t in texts], dtype=object)

    return code


def encode_rowwise(df: DataFrame, col: str, vocab: DataFrame, merges: DataFrame, out_col: str = "ids",
                   apply_nfkc: bool = True, unk_id: int = UNK_ID, model=None) -> DataFrame:
    """T9, row-local: an Arrow batch function encodes each row's words with
    a cache of encoded words in each task.  No shuffle at all (nothing can be
    hot); Python sees every token once instead of every distinct word once."""
    b_ranks, b_ids = model or broadcast_model(df.sparkSession, vocab, merges)
    return df.withColumn(out_col, _row_coder(b_ranks, b_ids, unk_id, apply_nfkc)(F.col(col)))


def word_parts(marked: str, apply_nfkc: bool = True) -> list:
    """The pieces of work in one marked raw word: normalised words, cut at literal specials (B24), which are parts themselves."""
    words = [marked]
    if apply_nfkc and not marked.isascii():
        words = [WORD_MARK + w for w in split_white_space(unicodedata.normalize("NFKC", marked[len(WORD_MARK):]))]
    return [part for w in words for part in (LITERAL_SPECIALS.split(w) if "[" in w else [w]) if part]


def _part_splitter(apply_nfkc: bool):
    @F.pandas_udf(ArrayType(StringType()))
    def parts(words: pd.Series) -> pd.Series:
        return words.map(lambda w: word_parts(w, apply_nfkc))

    return parts


def _part_coder(unk_id: int):
    def run(batches):
        for pdf in batches:
            out = []
            for part, ids, ranks in zip(pdf["part"], pdf["ids"], pdf["ranks"]):
                known = {x["piece"]: int(x["id"]) for x in ids}
                if part in SPECIAL_SET:
                    out.append([known.get(part, unk_id)])
                else:
                    out.append(encode_word(part, {(x["left"], x["right"]): int(x["rank"]) for x in ranks}, known, unk_id))
            yield pd.DataFrame({"part": pdf["part"], "pids": out})

    return run


def encode_by_pieces(df: DataFrame, key: str, col: str, vocab: DataFrame, merges: DataFrame, out_col: str = "ids",
                     apply_nfkc: bool = True, unk_id: int = UNK_ID) -> DataFrame:
    """T9 for models of any size: each distinct word meets the few merges and pieces that it can use.

    A merge applies to a word only if the piece it makes is a part of the word's text, so
    the substrings of the distinct words (no longer than the longest piece) are joined with the
    merges and the vocabulary, and each word is encoded with what it found.  Nothing of the
    model is broadcast or collected.
    """
    toks = df.select(F.col(key).alias("_k"), F.posexplode(marked_words(col, False)).alias("pos", "word"))
    split = toks.select("word").distinct().select("word", F.posexplode(_part_splitter(apply_nfkc)("word")).alias("at", "part"))
    path = scratch_path(df.sparkSession, "word-parts")
    split.write.parquet(path)
    split = df.sparkSession.read.parquet(path)
    parts = split.select("part").distinct()
    longest = vocab.agg(F.max(F.length("piece"))).first()[0] or 1
    subs = F.expr(f"array_distinct(flatten(transform(sequence(1, length(part)), i -> transform(sequence(1, least({int(longest)}, length(part) - i + 1)), "
                  "n -> substring(part, i, n)))))")
    pieces = parts.select("part", F.explode(subs).alias("piece"))
    made = merges.select(F.concat("left", "right").alias("piece"), "left", "right", "rank")
    ids = pieces.join(vocab.select("piece", "id"), "piece").groupBy("part").agg(F.collect_list(F.struct("piece", "id")).alias("ids"))
    ranks = pieces.join(made, "piece").groupBy("part").agg(F.collect_list(F.struct("left", "right", "rank")).alias("ranks"))
    none = {"ids": F.coalesce("ids", F.expr("CAST(array() AS array<struct<piece: string, id: int>>)")),
            "ranks": F.coalesce("ranks", F.expr("CAST(array() AS array<struct<left: string, right: string, rank: int>>)"))}
    known = parts.join(ids, "part", "left").join(ranks, "part", "left").withColumns(none)
    coded = known.mapInPandas(_part_coder(unk_id), "part string, pids array<int>")

    def in_order(pos: str, what: str):
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(pos, what))), lambda x: x[what])).alias("wids")

    words = split.join(coded, "part").groupBy("word").agg(in_order("at", "pids"))
    grouped = toks.join(words, "word").groupBy("_k").agg(in_order("pos", "wids").alias("_ids"))
    out = df.join(grouped, F.col(key) == F.col("_k"), "left")
    got = F.when(F.col(col).isNotNull(), F.coalesce(F.col("_ids"), F.array().cast("array<int>")))
    return out.select(*[F.col(c) for c in df.columns], got.alias(out_col))


def encode(df: DataFrame, key: str, col: str, vocab: DataFrame, merges: DataFrame, out_col: str = "ids",
           apply_nfkc: bool = True, unk_id: int = UNK_ID, model=None, hot_words: int = HOT_WORDS,
           strategy: str | None = None) -> DataFrame:
    """Text to subword ids.

    By default each row is encoded where it is (:func:`encode_rowwise`: one
    scan, no shuffle; 9.5 s against 15-20 s for the join on 85,513 lines
    locally), unless the vocabulary or the merges have more than
    ``tokenizer.MAX_BROADCAST_VOCAB`` rows: such a model is not sent to the workers, but
    joined (``strategy="shuffle"``, :func:`encode_by_pieces`); the ids are the same.
    ``strategy="join"`` encodes distinct words with a model sent to the workers.  There, words are counted (partial aggregation, so a hot word is combined map
    side) and each *distinct* word is encoded once.  The pieces go back to the
    tokens in two joins: the ``hot_words`` most frequent words (a bounded
    table) by broadcast, the rest by a shuffle join in which no key is more
    frequent than the last hot word.  Tokens then regroup per row.
    """
    if strategy is None:
        large = model is None and any(t.limit(tok.MAX_BROADCAST_VOCAB + 1).count() > tok.MAX_BROADCAST_VOCAB for t in (vocab, merges))
        strategy = "shuffle" if large else "rowwise"
    if strategy == "shuffle":
        return encode_by_pieces(df, key, col, vocab, merges, out_col, apply_nfkc, unk_id)
    if strategy == "rowwise":
        return encode_rowwise(df, col, vocab, merges, out_col, apply_nfkc, unk_id, model)
    spark = df.sparkSession
    b_ranks, b_ids = model or broadcast_model(spark, vocab, merges)
    # raw words only (JVM); NFKC runs inside the coder, once per distinct word
    toks = df.select(F.col(key).alias("_k"), F.posexplode(marked_words(col, False)).alias("pos", "word"))
    counted = toks.groupBy("word").agg(F.count(F.lit(1)).alias("_f"))
    schema = StructType([StructField("word", StringType()), StructField("_f", LongType()),
                         StructField("wids", ArrayType(IntegerType()))])
    coder = _word_coder(b_ranks, b_ids, unk_id, apply_nfkc)
    # hot and cold words are disjoint, so every distinct word is encoded once
    hot_words_df = counted.orderBy(F.desc("_f"), F.asc("word")).limit(hot_words)
    # the limit leaves one partition: spread the (bounded) hot list before coding
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    hot = hot_words_df.repartition(parts).mapInPandas(coder, schema).select("word", F.col("wids").alias("_hw"))
    cold = counted.join(F.broadcast(hot_words_df.select("word")), "word", "left_anti").mapInPandas(coder, schema)
    via_hot = toks.join(F.broadcast(hot), "word", "left")
    hit = via_hot.where(F.col("_hw").isNotNull()).select("_k", "pos", F.col("_hw").alias("wids"))
    miss = via_hot.where(F.col("_hw").isNull()).select("_k", "pos", "word").join(cold.select("word", "wids"), "word")
    miss = miss.select("_k", "pos", "wids")
    joined = hit.unionByName(miss)
    grouped = joined.groupBy("_k").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "wids"))), lambda x: x["wids"])).alias("_ids")
    )
    out = df.join(grouped, F.col(key) == F.col("_k"), "left")
    ids = F.when(F.col(col).isNull(), F.lit(None).cast("array<int>")).otherwise(
        F.coalesce(F.col("_ids"), F.array().cast("array<int>"))
    )
    return out.select(*[F.col(c) for c in df.columns], ids.alias(out_col))
