"""What a chain of text filters removes, in every order of the filters.

Five filters judge whole texts: A under 50 words, B fewer distinct words than
65 % of the words, C more capitals A-Z than 5 % of the code points, D one of
``#$%&*|``, E a text that a smaller id has as well, anywhere in the table.

A to D are decided where the row is.  For E, texts are put into compressed tries
whose terminals hold the smallest id:

1.  Prefixes of 8 bytes are weighed by the bytes of the texts that begin with
    them; those that are too heavy for one trie are weighed again by longer
    prefixes (4 times as long), and so on.  A text's cell is its shortest prefix
    that is not too heavy.
2.  A task first compares the texts that it holds: a row whose text a smaller id
    has among them is a duplicate whatever other tasks hold, so of a group of
    copies each task sends on little more than the row of the smallest id.
3.  The others are range-partitioned by their cells and inserted whole in a
    trie; a traversal compares each row with the smallest id at its terminal.

Each row is then a mask of five bits, and masks are counted by part, so the 120
orders work on at most 32 counts a part.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ragged import mix64, offsets_of, plain_text, release, row_slices, split_words, string_bytes
from tessera.llm.shared import stored
from tessera.llm.text_trie import TextTrie
from tessera.llm.wordhash import HASH_BYTES

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PER_CENT = 65
CAPITAL_PER_CENT = 5
SYMBOLS = "#$%&*|"
#: Prefix lengths in bytes that texts are told apart by.
LEVELS = [8 * 4**k for k in range(13)]
#: Bytes that a row counts besides its text.
ROW_BYTES = 64
#: Cells are cut so that each reduce partition has about this many at least, but not below CELL_BYTES.
CELLS = 4
CELL_BYTES = 1 << 16
#: Bytes of text that one trie holds before it is traversed, at the end of a cell.
TRIE_BYTES = 8 << 20
#: Bytes of repeated texts that a task remembers from one slice to the next (affects what is shuffled, not the result).
REMEMBERED_BYTES = 16 << 20


def _prefix_hashes(text):
    """Hash of the prefix of each level; null from where the text is not longer."""
    raw = text.cast("binary")
    return F.array(*[F.when(F.octet_length(text) > n, F.xxhash64(F.substring(raw, 1, n))) for n in LEVELS])


def _heavy_prefixes(texts: DataFrame, partitions: int) -> list[set[int]]:
    """Per level, hashes of the prefixes that are too heavy for one cell.

    Each is heavier than ``1 / (CELLS * partitions)`` of all texts, so there are at most
    ``CELLS * partitions`` a level, and only the rows of a heavy prefix are weighed again.
    """
    rows = stored(texts.select((F.octet_length("text") + ROW_BYTES).cast("long").alias("weight"), F.col("hashes").alias("h")), "prefixes")
    total = rows.agg(F.sum("weight")).first()[0] or 0
    limit = max(total // (CELLS * partitions), CELL_BYTES)
    out: list[set[int]] = []
    for k in range(len(LEVELS)):
        if k:
            above = rows.sparkSession.createDataFrame([(h,) for h in out[-1]], "above long")
            rows = rows.join(F.broadcast(above), F.get("h", F.lit(k - 1)) == F.col("above"), "left_semi")
        key = F.get("h", F.lit(k))
        heavy = rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.sum("weight").alias("w")).where(F.col("w") > limit)
        found = {r.key for r in heavy.select("key").collect()}
        if not found:
            break
        out.append(found)
    return out


def _cells(data: np.ndarray, bounds: np.ndarray, hashes: pa.Array, rows: np.ndarray, heavy: list[set[int]]) -> list[bytes]:
    raw = memoryview(data)
    out = []
    for i in rows.tolist():
        own = hashes[i].as_py() if heavy else ()
        level = 0
        while level < len(heavy) and own[level] in heavy[level]:
            level += 1
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        out.append(bytes(raw[lo:min(hi, lo + LEVELS[level]) if level < len(LEVELS) else hi]))
    return out


def _bits(text: pa.StringArray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Filters A to D of each text."""
    n = len(bounds) - 1
    codes, offsets, _ = split_words(text)
    words = np.diff(offsets)
    pairs = np.unique(np.repeat(np.arange(n, dtype=np.int64), words) << 32 | codes)
    distinct = np.bincount(pairs >> 32, minlength=n)

    def count(table) -> np.ndarray:
        return np.diff(offsets_of(table[data])[bounds])

    byte = np.arange(256)
    capitals = count((byte >= 0x41) & (byte <= 0x5A))
    points = count((byte & 0xC0) != 0x80)
    symbols = count(np.isin(byte, [ord(c) for c in SYMBOLS]))
    return ((words < LEAST_WORDS) * 1 + (100 * distinct < DISTINCT_PER_CENT * words) * 2
            + (100 * capitals > CAPITAL_PER_CENT * points) * 4 + (symbols > 0) * 8).astype(np.int32)


JUDGED = "doc_id long, part string, mask int, cell binary, text string"


def _judge(shipped: Broadcast):
    """Mask of A to D for every row, E too where this task can tell; the others keep their text and its cell."""

    def run(batches):
        heavy = shipped.value
        known: dict[str, int] = {}
        room = REMEMBERED_BYTES
        for batch in row_slices(batches, "text", HASH_BYTES):
            text = plain_text(batch.column("text"))
            data, bounds = string_bytes(text)
            mask = _bits(text, data, bounds)
            given = np.asarray(batch.column("doc_id").is_valid())
            ids = np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64)
            coded = text.dictionary_encode()
            code = np.asarray(coded.indices)
            top = np.iinfo(np.int64).max
            least = np.full(len(coded.dictionary), top)
            np.minimum.at(least, code[given], ids[given])
            times = np.bincount(code[given], minlength=len(least))
            for c, t in enumerate(coded.dictionary.to_pylist()):
                before = known.get(t)
                if before is not None:
                    least[c] = known[t] = min(before, int(least[c]))
                elif times[c] > 1 and len(t) <= room:
                    known[t] = int(least[c])
                    room -= len(t) + ROW_BYTES
            repeat = given & (ids > least[code])
            mask[repeat] |= 16
            ask = given & ~repeat
            rows = np.flatnonzero(ask)
            # rows that are settled carry no text and go anywhere
            spread = mix64((ids + np.arange(len(ids))).view(np.uint64)).astype(">u8").tobytes()
            cells = [spread[8 * i:8 * i + 8] for i in range(len(ids))]
            for i, cell in zip(rows.tolist(), _cells(data, bounds, batch.column("hashes"), rows, heavy)):
                cells[i] = cell
            texts = text.take(pa.array(np.arange(len(ids)), mask=~ask))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(mask), pa.array(cells, pa.binary()), texts],
                ["doc_id", "part", "mask", "cell", "text"])

    return run


def _tried(batches):
    """Masks with E, from rows sorted by cell; one trie at a time."""
    trie, last = TextTrie(), None

    def flagged(rows):
        ids, parts, masks = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string()), pa.array(masks, pa.int32())],
                                          ["doc_id", "part", "mask"])

    def traversed(trie: TextTrie):
        rows = []
        for least, members in trie.terminals():
            rows.extend((i, part, mask | 16 if i > least else mask) for i, part, mask in members)
            if len(rows) > 50_000:
                yield flagged(rows)
                rows = []
        if rows:
            yield flagged(rows)

    for batch in batches:
        settled = batch.column("text").is_null()
        yield batch.filter(settled).select(["doc_id", "part", "mask"])
        rest = batch.filter(pc.invert(settled))
        columns = [rest.column(c) for c in ("cell", "text", "doc_id", "part", "mask")]
        for lo in range(0, rest.num_rows, 256):
            for cell, text, *row in zip(*(c.slice(lo, 256).to_pylist() for c in columns)):
                if trie.size > TRIE_BYTES and cell != last:
                    yield from traversed(trie)
                    trie = TextTrie()
                    release()
                last = cell
                trie.insert(text.encode(), row[0], tuple(row))
    yield from traversed(trie)


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, mask`` for every row; bit ``i`` of ``mask`` is set when the text fails filter ``FILTERS[i]``.

    A null text is the empty text, a null part the empty string.  Words are runs of
    anything but ASCII white space; the empty text fails A alone, or A and E.  Rows that
    repeat an id with the same text are judged alike (no smaller id has the text); a
    row without an id never fails E and makes no other row fail it.  An empty table gives
    an empty one; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       text.alias("text"), _prefix_hashes(text).alias("hashes"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    heavy = _heavy_prefixes(rows, partitions)
    judged = rows.mapInArrow(_judge(spark.sparkContext.broadcast(heavy)), JUDGED)
    dealt = judged.repartitionByRange(partitions, "cell").sortWithinPartitions("cell")
    return stored(dealt.mapInArrow(_tried, "doc_id long, part string, mask int"), "masks")


def audit(counts: DataFrame) -> DataFrame:
    """Rows of the report from ``part, mask, n, good, toxic`` (at most 32 a part): every order and step."""
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    table = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("h"))
    steps = table.select("part", "h", F.explode(orders).alias("filter_order")).select(
        "part", "h", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    steps = steps.withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)")).withColumn(
        "before", F.expr(f"aggregate(sequence(0, step - 1), 0, (m, i) -> m | if(i = 0, 0, shiftleft(1, instr('{FILTERS}', substring(filter_order, i, 1)) - 1)))"))

    def total(column: str, condition: str):
        return F.expr(f"aggregate(filter(h, x -> {condition}), 0L, (s, x) -> s + x.{column})")

    here = "x.mask & bit <> 0 AND x.mask & before = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("n", "x.mask & (before | bit) = 0").alias("kept"),
        total("n", here).alias("removed"),
        total("n", "x.mask & bit <> 0 AND x.mask & before <> 0").alias("redundant"),
        total("n", "x.mask = bit").alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # of all orders, those in which the filter comes first among those that the text fails
        F.expr("aggregate(filter(h, x -> x.mask & bit <> 0), 0L, (s, x) -> s + x.n * (120 div bit_count(x.mask)))").alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    One row a part, order of the filters and step; see :func:`filter_masks` for what
    nulls, repeated rows and ties mean.  ``labels`` has ``doc_id, quality, toxic``; a
    document of several labels is good or toxic if one of them says so, one without
    a label, or without an id, is neither.
    """
    masks = filter_masks(docs, id_col, text_col, part_col)
    named = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0).cast("long")).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0).cast("long")).alias("toxic"))
    joined = masks.where("doc_id IS NOT NULL").join(named, "doc_id", "left").select(
        "part", "mask", F.coalesce("good", F.lit(0).cast("long")).alias("good"), F.coalesce("toxic", F.lit(0).cast("long")).alias("toxic"))
    nameless = masks.where("doc_id IS NULL").select("part", "mask", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    counts = joined.union(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return audit(counts)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
m AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
h AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT concat(f1.f, f2.f, f3.f, f4.f, f5.f) AS filter_order FROM f f1, f f2, f f3, f f4, f f5
  WHERE len(list_distinct([f1.f, f2.f, f3.f, f4.f, f5.f])) = 5),
s AS (
  SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS i,
    list_transform(string_split(filter_order[1:step - 1], ''), lambda x: instr('ABCDE', x)) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
j AS (
  SELECT part, filter_order, step, n, good, toxic, fails[i] AS failed, len(list_filter(fails, lambda x: x)) = 1 AS alone,
    step > 1 AND len(list_filter(before, lambda k: k > 0 AND fails[k])) > 0 AS gone FROM h, s),
r AS (
  SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (failed AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (failed AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (failed AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (failed AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM j GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM r
"""
