"""Near-duplicate join on word shingles: an exact Jaccard join with pivots.

Jaccard distance is a metric, and almost all pairs of documents are at distance
1, so cells around a few pivots of the whole corpus would each border on all
others.  Pivots are therefore taken from the documents that share a shingle:

1.  Equal sets are one class.  Shingles are put in one order for all classes:
    by hash, those of many classes last.  Two linked classes have a shingle in
    common within the first fifth of either (``size - ceil(0.8 size) + 1``).
2.  The classes that share such a shingle are a region.  (In the region of a frequent shingle only
    classes take part that can make a link by frequent shingles alone, at least 80 % of the set: two
    that share a rarer shingle meet there.)  Regions with the same least class are taken together, as
    the shingles of one family of copies all have nearly the same classes; where that is much more than the
    largest of them, they stay apart.
3.  A large region is split by pivots of several cells (components, as far as they are known): each member
    goes to the Voronoi region of its nearest pivot, those farther than ``FAR`` from all to a
    remainder, and it is copied into every other one that the triangle inequality allows a link to
    reach, so that no boundary is lost.  Links with pivots join components: a group of copies is closed by
    its first pivot.  What holds several components goes on, recursively.
4.  Regions that are small, or that pivots do not part (sets just below the threshold to
    each other, where windows cover everything), are compared in tiles inside tasks: the sizes of
    all intersections of a tile are counted as matrix products, and a tile passes on a
    forest of its links, never its pairs.  Members of one cell are not compared with each other.

All links are found up to those inside a component, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.ragged import mix64, offsets_of, release, row_slices
from tessera.llm.shared import stored
from tessera.llm.wordhash import HASH_BYTES, LOWER, hash_words, longs, shingle_sets

WORDS = 5
#: The sample of a set: its shingles in the least quarter of all hashes.
SAMPLED = np.uint64(1 << 62)
#: Two sets link when PER_CENT * union <= 100 * intersection.
PER_CENT = 80
#: A shingle that more classes have among their first is put last in the order.
FREQUENT = 16
#: Members, and shingles in all their sets, that are compared together; larger regions are split.
LEAF, LEAF_SHINGLES = 512, 1 << 20
#: Pivots of a split, rounds of splits, and the distance from which a member is near none of the pivots.
PIVOTS, LEVELS, FAR = 16, 3, 0.5
#: Copies of its members, as a multiple, that a split may make; beyond, the region is compared in tiles.
COPIES = 2
#: Regions of one least class are taken together up to so many times the members of the largest, or a leaf.
TOGETHER = 4
#: Bytes of sets in one Arrow batch, about.
BATCH_BYTES = 16 << 20
#: Frequent shingles sent to all tasks at most (12 bytes each in Python); beyond, only more frequent ones are.
MOST_FREQUENT = 1 << 21


def _sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and offsets, a 64-bit mark of each set and a second one to check it."""
    sets, offsets = shingle_sets(hash_words(batch.column("text"), LOWER), words)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    mark, check = np.zeros(len(offsets) - 1, np.uint64), np.zeros(len(offsets) - 1, np.uint64)
    if len(full):
        mark[full] = mix64(np.add.reduceat(mix64(sets), offsets[:-1][full]))
        check[full] = np.add.reduceat(mix64(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), offsets[:-1][full])
    return sets, offsets, mark, check


def _prefix(size: int, per_cent: int) -> int:
    return size - -(-size * per_cent // 100) + 1


def _slim(words: int):
    """Of each text: size and marks of its set, and the sample of it (32 bits of each shingle in the least quarter)."""
    def run(batches):
        for batch in row_slices(batches, "text", HASH_BYTES):
            sets, offsets, mark, check = _sets(batch, words)
            n = offsets[1:] - offsets[:-1]
            low = sets < SAMPLED
            ends = offsets_of(low)[offsets]
            raw = memoryview((sets[low] >> np.uint64(30)).astype("<u4")).cast("B")
            sample = pa.array([raw[4 * s:4 * e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(mark.view(np.int64), pa.int64(), mask=n == 0), longs(check), sample],
                ["doc_id", "n_shingles", "mark", "check", "sample"])

    return run


def _first_shingles(words: int, per_cent: int):
    """(key, mark) of the first shingles in hash order, each once a slice."""
    def run(batches):
        for batch in row_slices(batches, "text", HASH_BYTES):
            sets, offsets, mark, _ = _sets(batch, words)
            _, each = np.unique(mark, return_index=True)
            keys, marks = [], []
            for i in each.tolist():
                lo, hi = offsets[i], offsets[i + 1]
                if hi > lo:
                    p = _prefix(int(hi - lo), per_cent)
                    keys.append(sets[lo:lo + p])
                    marks.append(np.full(p, mark[i]))
            if keys:
                yield pa.RecordBatch.from_arrays([longs(np.concatenate(keys)), longs(np.concatenate(marks))], ["key", "mark"])

    return run


def _members(words: int, per_cent: int, shipped):
    """(key, mark, pivot, h) of the first shingles in the final order.

    Pivot, and the number ``h`` of frequent shingles in the set, are given for frequent ones only.
    """
    def run(batches):
        frequent, pivots = shipped.value
        for batch in row_slices(batches, "text", HASH_BYTES):
            sets, offsets, mark, _ = _sets(batch, words)
            at = np.minimum(np.searchsorted(frequent, sets), max(len(frequent) - 1, 0))
            often = frequent[at] == sets if len(frequent) else np.zeros(len(sets), bool)
            _, each = np.unique(mark, return_index=True)
            picked, marks, frequents = [], [], []
            for i in each.tolist():
                lo, hi = offsets[i], offsets[i + 1]
                if hi > lo:
                    p = _prefix(int(hi - lo), per_cent)
                    own = often[lo:hi]
                    rare = np.flatnonzero(~own)[:p]
                    if len(rare) < p:
                        rare = np.concatenate([rare, np.flatnonzero(own)[:p - len(rare)]])
                    picked.append(lo + rare)
                    marks.append(np.full(p, mark[i]))
                    frequents.append(np.full(p, own.sum(), np.int32))
            if picked:
                picked = np.concatenate(picked)
                pivot = pivots[at[picked]].view(np.int64) if len(frequent) else np.zeros(len(picked), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [longs(sets[picked]), longs(np.concatenate(marks)), pa.array(pivot, pa.int64(), mask=~often[picked]),
                     pa.array(np.concatenate(frequents), pa.int32(), mask=~often[picked])], ["key", "mark", "pivot", "h"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, mark): members of keys with two marks at least, with the key's least mark as pivot.

    Runs over the stream with one row kept back; a key's rows are not gathered.
    Rows that have a pivot come last and pass, each once.
    """
    key = pivot = None
    alone = False  # the pivot's own row is held back until another mark comes
    last = None
    passed = None
    for batch in batches:
        given = np.asarray(pc.is_valid(batch.column("pivot")))
        if given.any():
            rest = batch.filter(pa.array(given))
            keys, marks = np.asarray(rest.column("key")), np.asarray(rest.column("mark"))
            fresh = np.concatenate([[(keys[0], marks[0]) != passed], (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])])
            passed = (keys[-1], marks[-1])
            yield rest.filter(pa.array(fresh))
            batch = batch.filter(pa.array(~given))
        keys, marks = np.asarray(batch.column("key")), np.asarray(batch.column("mark"))
        out = ([], [], [])

        def put(k, m, p):
            out[0].append(k), out[1].append(m), out[2].append(p)

        n = len(keys)
        if not n:
            continue
        # rows that are alone with their key go in one step
        before = np.concatenate([[keys[0] == key], keys[1:] == keys[:-1]])
        after = np.concatenate([before[1:], [True]])  # the last row may go on in the next batch
        if not before[0]:
            alone = False
        for i in np.flatnonzero(before | after).tolist():
            k, m = int(keys[i]), int(marks[i])
            if k != key:
                key, pivot, alone, last = k, m, True, m
            elif m != last:
                if alone:
                    put(key, pivot, pivot)
                    alone = False
                put(k, m, pivot)
                last = m
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in out), pa.nulls(len(out[0]), pa.int32())], ["key", "mark", "pivot", "h"])


def _set_rows(words: int):
    def run(batches):
        for batch in row_slices(batches, "text", HASH_BYTES):
            sets, offsets, mark, _ = _sets(batch, words)
            raw = memoryview(sets.astype("<u8")).cast("B")
            yield pa.RecordBatch.from_arrays(
                [longs(mark), pa.array([raw[8 * s:8 * e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())],
                ["mark", "s"])

    return run


def _ragged_sets(column: pa.Array, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data.view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of the sets ``a`` with each of ``b`` (flat values, offsets).

    A value that many sets hold is a column of a dense matrix product; of one that few hold the
    pairs are counted.
    """
    n, m = len(a[1]) - 1, len(b[1]) - 1
    out = np.zeros(n * m, np.int64)
    shared = np.intersect1d(a[0], b[0])

    def entries(x):
        rows = np.repeat(np.arange(len(x[1]) - 1), np.diff(x[1]))
        at = np.minimum(np.searchsorted(shared, x[0]), max(len(shared) - 1, 0))
        held = np.flatnonzero(shared[at] == x[0]) if len(shared) else np.zeros(0, np.int64)
        order = held[np.argsort(at[held], kind="stable")]
        return at[order], rows[order]

    (ca, ra), (cb, rb) = entries(a), entries(b)
    na, nb = np.bincount(ca, minlength=len(shared)), np.bincount(cb, minlength=len(shared))
    sa, sb = offsets_of(na), offsets_of(nb)
    many = na * nb > 64
    few = np.flatnonzero(~many)
    for lo in range(0, len(few), 1 << 15):
        c = few[lo:lo + (1 << 15)]
        pairs = na[c] * nb[c]
        col = np.repeat(c, pairs)
        k = np.arange(len(col)) - np.repeat(offsets_of(pairs)[:-1], pairs)
        out += np.bincount(ra[sa[col] + k // nb[col]] * m + rb[sb[col] + k % nb[col]], minlength=n * m)
    out = out.reshape(n, m)
    place = np.cumsum(many) - 1
    wide_a, wide_b = many[ca], many[cb]
    pa_, qa, pb_, qb = place[ca[wide_a]], ra[wide_a], place[cb[wide_b]], rb[wide_b]
    width = 2048
    for lo in range(0, int(many.sum()), width):
        x, y = np.zeros((n, width), np.float32), np.zeros((m, width), np.float32)
        i, j = slice(*np.searchsorted(pa_, [lo, lo + width])), slice(*np.searchsorted(pb_, [lo, lo + width]))
        x[qa[i], pa_[i] - lo] = 1
        y[qb[j], pb_[j] - lo] = 1
        out += np.rint(x @ y.T).astype(np.int64)
    return out


def _rooted(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one key after the other, from rows sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(values[:, lo].tolist())
            if held and key != last:
                yield whole()
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield whole()


def _promising(keys: list[str], per_cent: int):
    """Members of each group that may be linked with one of another cell, by sizes and samples alone.

    What only one of two samples has only one of the two sets has.  Cut to 32 bits, different shingles may count
    as equal, which lets a member through at most.
    """
    reach = 1 - per_cent / 100 + 1e-9

    def run(batches):
        for group in _groups(batches, keys):
            side = np.asarray(group.column("side"))
            cells, n = np.asarray(group.column("cell")), np.asarray(group.column("n")).astype(np.float64)
            left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
            a, b = (_ragged_sets(group.column("s").take(pa.array(x)), np.uint32) for x in (left, right))
            apart = np.diff(a[1])[:, None] + np.diff(b[1])[None, :] - 2 * overlaps(a, b)
            total = n[left][:, None] + n[right][None, :]
            may = 2 * apart <= reach * (total + apart)
            may &= 1 - np.minimum(n[left][:, None], n[right][None, :]) / np.maximum(n[left][:, None], n[right][None, :]) <= reach
            may &= cells[left][:, None] != cells[right][None, :]
            keep = np.zeros(len(side), bool)
            keep[left] |= may.any(axis=1)
            keep[right] |= may.any(axis=0)
            if keep.any():
                yield group.filter(pa.array(keep)).select([*keys, "mark", "cell", "side"])
            release()

    return run


def _forest(batches_keys: list[str], per_cent: int):
    """Links of the rows of each group between different cells, as a forest of the cells.

    ``side`` 0 meets side 1; where a group has one side, all its members meet.
    """
    def run(batches):
        for group in _groups(batches, batches_keys):
            side = np.asarray(group.column("side"))
            marks, cells = np.asarray(group.column("mark")), np.asarray(group.column("cell"))
            left = np.flatnonzero(side == side.min())
            right = np.flatnonzero(side == side.max())
            sets = [_ragged_sets(group.column("s").take(pa.array(x))) for x in ((left,) if len(left) == len(side) else (left, right))]
            common = overlaps(sets[0], sets[-1])
            na, nb = np.diff(sets[0][1]), np.diff(sets[-1][1])
            linked = 100 * common >= per_cent * (na[:, None] + nb[None, :] - common)
            linked &= cells[left][:, None] != cells[right][None, :]
            parent: dict[int, int] = {}
            a, b = [], []
            for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
                x, y = _rooted(parent, int(cells[left[i]])), _rooted(parent, int(cells[right[j]]))
                if x != y:
                    parent[x] = y
                    a.append(marks[left[i]])
                    b.append(marks[right[j]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            release()

    return run


SPLIT = "up long, g long, mark long, cell long, n long, other long"


def _split(per_cent: int):
    """Regions of the members of a tile by the pivots that came with it, and links with the pivots (in ``other``)."""
    reach = 1 - per_cent / 100 + 1e-9

    def run(batches):
        for group in _groups(batches, ["g", "tile"]):
            pivot = np.asarray(group.column("side")) == 0
            p, x = group.filter(pa.array(pivot)), group.filter(pa.array(~pivot))
            if not x.num_rows:
                continue
            sp, sx = _ragged_sets(p.column("s")), _ragged_sets(x.column("s"))
            common = overlaps(sx, sp)
            either = np.diff(sx[1])[:, None] + np.diff(sp[1])[None, :] - common
            d = 1 - common / either
            nearest = d.min(axis=1)
            home = d.argmin(axis=1)
            # a link is at most ``reach`` away: from a member of the region of q, nearest + 2 reach, and FAR + reach
            goes = d <= np.minimum(nearest + 2 * reach, FAR + reach)[:, None]
            goes[nearest <= FAR, home[nearest <= FAR]] = True
            goes = np.column_stack([goes, nearest > FAR - reach])  # the remainder last
            at, to = np.nonzero(goes)
            g, marks, names = (np.asarray(c).astype(np.int64) for c in (x.column("g"), x.column("mark"), p.column("mark")))
            seeds = np.append(names, -1).view(np.uint64)[to]
            child = mix64(mix64(g[at].view(np.uint64)) ^ mix64(seeds + np.uint64(0x9E3779B97F4A7C15)))
            n, cell = np.asarray(x.column("n")), np.asarray(x.column("cell"))
            yield pa.RecordBatch.from_arrays([pa.array(g[at]), longs(child), pa.array(marks[at]), pa.array(cell[at]), pa.array(n[at]),
                                              pa.nulls(len(at), pa.int64())], [f.split()[0] for f in SPLIT.split(", ")])
            i, j = np.nonzero((100 * common >= per_cent * either) & (marks[:, None] != names[None, :]))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(g[i]), pa.array(g[i]), pa.array(marks[i]), pa.array(cell[i]), pa.array(n[i]),
                                                  pa.array(names[j])], [f.split()[0] for f in SPLIT.split(", ")])
            release()

    return run


class _Join:
    def __init__(self, df: DataFrame, id_col: str, text_col: str, words: int, per_cent: int, frequent: int):
        self.spark: SparkSession = df.sparkSession
        self.docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        self.words, self.per_cent, self.frequent = words, per_cent, frequent
        #: Partitions of rows that carry sets: few bytes are still much work, so their number is not left to their size.
        self.parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)

    def classes(self) -> tuple[DataFrame, DataFrame]:
        slim = stored(self.docs.mapInArrow(_slim(self.words), "doc_id long, n_shingles long, mark long, check long, sample binary"), "slim")
        classes = stored(slim.where("mark IS NOT NULL").groupBy("mark").agg(
            F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min("n_shingles").alias("n_least"),
            F.min("check").alias("check"), F.max("check").alias("check_most")), "classes")
        if not classes.where("n <> n_least OR check <> check_most").isEmpty():
            raise RuntimeError("two different sets have the same 64-bit mark")
        self.largest = classes.agg(F.max("n")).first()[0] or 1
        return slim, classes

    def frequent_shingles(self):
        """Shingles that many classes have among their first, with the least such class: never more than a bound."""
        first = self.docs.mapInArrow(_first_shingles(self.words, self.per_cent), "key long, mark long")
        counts = first.groupBy("key").agg(F.count("*").alias("n"), F.min("mark").alias("pivot"))
        counts = stored(counts.where(F.col("n") > self.frequent), "frequent")
        least = self.frequent
        while (n := counts.where(F.col("n") > least).count()) > MOST_FREQUENT:
            least *= 2
        table = counts.where(F.col("n") > least).select("key", "pivot").toPandas() if n else None
        keys = np.zeros(0, np.uint64) if table is None else table["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        pivots = np.zeros(0, np.uint64) if table is None else table["pivot"].to_numpy(np.int64).view(np.uint64)
        return self.spark.sparkContext.broadcast((keys[order], pivots[order]))

    def members(self) -> DataFrame:
        """(key, mark, pivot, h) of all regions with two classes at least."""
        shipped = self.frequent_shingles()
        rows = self.docs.mapInArrow(_members(self.words, self.per_cent, shipped), "key long, mark long, pivot long, h int")
        # a frequent shingle has its pivot already, so its rows need not come together
        place = F.when(F.col("pivot").isNull(), F.col("key")).otherwise(F.xxhash64("key", "mark"))
        rows = rows.repartition(place).sortWithinPartitions(F.col("pivot").isNotNull(), "key", "mark")
        return stored(rows.mapInArrow(_shared, "key long, mark long, pivot long, h int"), "members")

    def regions(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """``g, mark, cell, n``: the members of the regions, those of the same least class taken together; cells are single classes."""
        rows = members.join(classes.select("mark", "n"), "mark").where(F.col("h").isNull() | (F.col("h") * 100 >= F.col("n") * self.per_cent))
        rows = stored(rows.select("key", "pivot", "mark", "n"), "region_members")
        once = stored(rows.groupBy("pivot", "mark").agg(F.max("n").alias("n")), "once")
        most = rows.groupBy("pivot", "key").agg(F.count("*").alias("c")).groupBy("pivot").agg(F.max("c").alias("most"))
        hubs = once.groupBy("pivot").agg(F.count("*").alias("u")).join(most, "pivot").where(
            F.col("u") > F.greatest(F.lit(LEAF), TOGETHER * F.col("most")))
        hubs = stored(hubs.select("pivot"), "hubs")
        together = once.join(hubs, "pivot", "left_anti").select(F.col("pivot").alias("g"), "mark", "n")
        apart = rows.join(hubs, "pivot", "left_semi").select(F.xxhash64("key", F.lit("apart")).alias("g"), "mark", "n").distinct()
        return stored(together.union(apart).select("g", "mark", F.col("mark").alias("cell"), "n"), "regions")

    def sets(self, marks: DataFrame, classes: DataFrame) -> DataFrame:
        """``mark, s``: the whole set of each of the classes, once."""
        wanted = stored(marks.distinct(), "wanted")
        ids = stored(classes.join(wanted, "mark", "left_semi").select("doc_id"), "ids")
        # rows that repeat an id and null ids come along; a class is kept once
        texts = self.docs.join(ids.where("doc_id IS NOT NULL"), "doc_id", "left_semi")
        if not ids.where("doc_id IS NULL").isEmpty():
            texts = texts.union(self.docs.where("doc_id IS NULL"))
        sets = texts.mapInArrow(_set_rows(self.words), "mark long, s binary")
        return stored(sets.join(wanted, "mark", "left_semi").groupBy("mark").agg(F.first("s").alias("s")), "sets")

    def compared(self, rows: DataFrame, keys: list[str], slim: DataFrame, classes: DataFrame, name: str) -> DataFrame:
        """Forests of the links in each group of ``keys`` (rows ``keys, mark, cell, n, side``).

        Samples go first, an eighth of the sets' bytes; whole sets follow for the members that they leave.
        """
        wanted = stored(rows.select("mark").distinct(), "sampled")
        samples = slim.where("mark IS NOT NULL").select("mark", "sample").join(wanted, "mark", "left_semi")
        samples = stored(samples.groupBy("mark").agg(F.first("sample").alias("s")), "samples")
        dealt = rows.join(samples, "mark").repartition(self.parts, *keys).sortWithinPartitions(*keys)
        columns = ", ".join(f"{k} long" for k in keys) + ", mark long, cell long, side int"
        left = self.in_small_batches(dealt.select(*keys, "mark", "cell", "n", "side", "s").mapInArrow(_promising(keys, self.per_cent), columns), "promising")
        sets = self.sets(left.select("mark"), classes)
        dealt = left.join(sets, "mark").repartition(self.parts, *keys).sortWithinPartitions(*keys)
        return self.in_small_batches(dealt.select(*keys, "mark", "cell", "side", "s").mapInArrow(_forest(keys, self.per_cent), "a long, b long"), name)

    def in_small_batches(self, df: DataFrame, name: str) -> DataFrame:
        """:func:`stored`, with Arrow batches of so few rows that the largest set in every row stays within ``BATCH_BYTES``."""
        setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
        conf = self.spark.conf
        before = conf.get(setting)
        conf.set(setting, str(max(16, min(int(before) if int(before) > 0 else 10_000, BATCH_BYTES // (8 * self.largest)))))
        try:
            return stored(df, name)
        finally:
            conf.set(setting, before)

    def links(self, now: DataFrame, slim: DataFrame, classes: DataFrame) -> DataFrame:
        """Links ``a, b`` between members of the same region, but for those that a path of links replaces."""
        several = F.min("cell").alias("lo"), F.max("cell").alias("hi")

        def sizes_of(rows: DataFrame, name: str) -> DataFrame:
            sizes = rows.groupBy("g").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), *several)
            return stored(sizes.where("lo <> hi").drop("lo", "hi").withColumn("tiles", F.greatest(
                F.ceil(F.col("members") / LEAF), F.ceil(F.col("shingles") / LEAF_SHINGLES)).cast("long")), name)

        edges, leaves = [], []
        tiled: list[DataFrame] = []
        sizes = sizes_of(now, "sizes")
        for level in range(LEVELS):
            leaves.append(now.join(sizes.where("tiles = 1").select("g"), "g", "left_semi"))
            large = sizes.where("tiles > 1")
            if large.isEmpty():
                break
            now = stored(now.join(large.select("g", "tiles", "members"), "g"), "split_members")
            split, found = self.split(now, large, self.sets(now.select("mark"), classes), level)
            edges.append(found)
            joined = components(_united(edges)).select(F.col("id").alias("mark"), "component_id")

            def relabelled(rows: DataFrame, name: str) -> DataFrame:
                return stored(rows.join(joined, "mark", "left").withColumn("cell", F.coalesce("component_id", "cell")).drop("component_id"), name)  # noqa: B023

            # windows that cover (nearly) everything part nothing: such a region is compared as it is
            copies = split.groupBy("up").agg(F.count("*").alias("copies")).join(large.select(F.col("g").alias("up"), "members"), "up")
            parted = stored(copies.where(F.col("copies") <= COPIES * F.col("members")).select("up"), "parted")
            tiled.append(relabelled(now.join(parted, F.col("g") == F.col("up"), "left_anti").select("g", "mark", "cell", "n"), "not_parted"))
            now = relabelled(split.join(parted, "up", "left_semi").select("g", "mark", "cell", "n"), "children")
            sizes = sizes_of(now, "sizes")
        else:
            tiled.append(now.select("g", "mark", "cell", "n"))
        if leaves:
            leaf = _united(leaves).select("g", "mark", "cell", "n", F.lit(0).alias("side"))
            edges.append(self.compared(leaf, ["g"], slim, classes, "leaf_links"))
        if tiled:
            rows = _united(tiled)
            rows = self.tile_rows(rows.join(sizes_of(rows, "tiled_sizes").select("g"), "g", "left_semi"))
            edges.append(self.compared(rows, ["g", "i", "j"], slim, classes, "tile_links"))
        return _united(edges)

    def tile_rows(self, rows: DataFrame) -> DataFrame:
        """Members with each pair ``i <= j`` of tiles of their region that they are compared in.

        A cell larger than a leaf has tiles of its own, which do not meet each other.
        """
        rows = stored(rows, "tiled")
        cells = rows.groupBy("g", "cell").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
        need = F.greatest(F.ceil(F.col("c") / LEAF), F.ceil(F.col("w") / LEAF_SHINGLES)).cast("long")
        own = stored(cells.withColumn("own", need).where("own > 1").select("g", "cell", "own", "c", "w"), "own_tiles")
        mixed = rows.groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("w")).join(
            own.groupBy("g").agg(F.sum("c").alias("oc"), F.sum("w").alias("ow"), F.sum("own").alias("owned")), "g", "left")
        left = F.greatest(F.ceil((F.col("c") - F.coalesce("oc", F.lit(0))) / LEAF), F.ceil((F.col("w") - F.coalesce("ow", F.lit(0))) / LEAF_SHINGLES))
        mixed = stored(mixed.select("g", left.cast("long").alias("mixed"), (left + F.coalesce("owned", F.lit(0))).cast("long").alias("total")), "mixed")
        before = Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # the large cells of a region
        ranges = own.select("g", "cell", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"))
        dealt = rows.join(mixed, "g").join(ranges, ["g", "cell"], "left").withColumn("first", F.col("mixed") + F.col("ahead"))
        h = F.xxhash64(F.lit("tile"), "mark")
        t = F.when(F.col("own").isNull(), F.pmod(h, F.col("mixed"))).otherwise(F.col("first") + F.pmod(h, F.col("own")))
        zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
        others = F.concat(F.when(F.col("first") > 0, F.sequence(zero, F.col("first") - 1)).otherwise(none),
                          F.when(F.col("first") + F.col("own") < F.col("total"), F.sequence(F.col("first") + F.col("own"), F.col("total") - 1)).otherwise(none))
        u = F.explode(F.when(F.col("own").isNull(), F.sequence(zero, F.col("total") - 1)).otherwise(others))
        dealt = dealt.withColumn("t", t).withColumn("u", u)
        return dealt.select("g", "mark", "cell", "n", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), (F.col("t") > F.col("u")).cast("int").alias("side"))

    def split(self, now: DataFrame, large: DataFrame, sets: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Members with their regions one level down (``up`` is the region above), and links with pivots."""
        order = F.struct(F.xxhash64("mark", F.lit(level)).alias("h"), F.col("mark").alias("mark"))
        pivots = now.groupBy("g", F.pmod(F.xxhash64("cell", F.lit(level)), F.lit(PIVOTS)).alias("b")).agg(F.min(order).alias("p"))
        pivots = stored(pivots.select("g", F.col("p.mark").alias("mark")).join(large.select("g", "tiles"), "g"), "pivots")
        tile = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
        none = F.lit(None).cast("long")
        rows = pivots.select("g", tile.alias("tile"), F.lit(0).alias("side"), "mark", none.alias("cell"), none.alias("n")).union(
            now.select("g", F.pmod(F.xxhash64(F.lit("tile"), "mark"), F.col("tiles")).alias("tile"), F.lit(1).alias("side"), "mark", "cell", "n"))
        rows = rows.join(sets, "mark").repartition(self.parts, "g", "tile").sortWithinPartitions("g", "tile")
        rows = rows.select("g", "tile", "side", "mark", "cell", "n", "s")
        out = self.in_small_batches(rows.mapInArrow(_split(self.per_cent), SPLIT), "split")
        return out.where("other IS NULL").drop("other"), out.where("other IS NOT NULL").select(F.col("mark").alias("a"), F.col("other").alias("b"))


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       per_cent: int = PER_CENT, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a
    text's set is its distinct ``words``-word shingles (the whole text as one if
    it has fewer words).  Rows link when the Jaccard similarity is at least
    ``per_cent`` / 100, exactly.  Null, empty and blank texts have no shingle
    and link with nothing.  Every row is in the result; rows that repeat an id
    each have their own text's component; a null id is null in
    ``component_id`` unless a linked row has an id.  An empty table gives an empty one; other
    columns are ignored, whatever their names.  Shingles are compared as 64-bit hashes.
    """
    j = _Join(df, id_col, text_col, words, per_cent, frequent)
    slim, classes = j.classes()
    joined = components(j.links(j.regions(j.members(), classes), slim, classes))
    named = classes.select("mark", "doc_id").join(joined.withColumnRenamed("id", "mark"), "mark", "left").withColumn(
        "cell", F.coalesce("component_id", "mark")).select("mark", "doc_id", "cell")
    named = stored(named, "named")
    least = stored(named.groupBy("cell").agg(F.min("doc_id").alias("component_id")), "least")
    by_mark = stored(named.join(least, "cell").select("mark", "component_id"), "by_mark")
    return slim.join(by_mark, "mark", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
