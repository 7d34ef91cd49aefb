"""The pair index that subword training works on: which words hold a pair, and signed count changes.

A *posting* says that a word, as it stands since ``version``, holds a pair, and by how
much that version changed the pair's count:

    pair STRING ("left right"), word STRING, freq BIGINT, syms STRING, version INT, delta BIGINT

``syms`` are the word's symbols joined by spaces; null marks a pair that the word has
lost.  Rewriting a word writes postings for all its pairs, so the newest posting
of a (pair, word) is current, and the sum of ``delta`` over a pair's postings is its count.  Postings are
written to the shared folder, a folder a round, ordered by pair so that a read of a few pairs
skips most of each file; every few rounds the live ones are written anew.
The first merges hold in much of all words; they are learned on the words themselves (:class:`WordTable`).

A round reads only the words that hold one of its pairs or of the merges since the last rewriting,
and only these words are ever rewritten.  The driver holds a bounded list of the best pairs with exact
counts, replays the round on the count changes that the words report for each step, and
keeps the longest prefix in which every step took the best pair of all, as merging one
pair at a time would.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

POSTING = "pair string, word string, freq bigint, syms string, version int, delta bigint"


def distinct_pairs(syms: str) -> Column:
    """Adjacent pairs of a space-joined symbol string; runs of one symbol count left to right without overlap."""
    s = F.col(syms)
    differ = F.regexp_extract_all(s, F.lit(r"(?<![^ ])(?=(([^ ]+) (?!\2(?: |$))[^ ]+))"), F.lit(1))
    same = F.regexp_extract_all(s, F.lit(r"(?<![^ ])([^ ]+) \1(?= |$)"), F.lit(0))
    return F.concat(differ, same)


def pairs_of(syms: list[str]) -> Counter:
    """The same for one word in a task."""
    out: Counter = Counter()
    i, run = 0, 0  # ``run``: equal symbols before this one that are not part of a counted pair yet
    for i in range(len(syms) - 1):
        if syms[i] != syms[i + 1]:
            out[syms[i], syms[i + 1]] += 1
            run = 0
        else:
            if run == 0:
                out[syms[i], syms[i + 1]] += 1
            run = 1 - run
    return out


def merge_pair(syms: list[str], left: str, right: str) -> list[str]:
    """Join every occurrence from left to right."""
    out, i = [], 0
    while i < len(syms):
        if i + 1 < len(syms) and syms[i] == left and syms[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


def apply_merges(syms: list[str], steps: dict[tuple[str, str], int]) -> Iterator[tuple[int, list[str]]]:
    """(step, symbols after it) for the steps of an ordered sequence of merges that change the word."""
    last = -len(steps) - 1
    while True:
        step, pair = min(((steps[p], p) for p in zip(syms, syms[1:]) if p in steps and steps[p] > last), default=(None, None))
        if step is None:
            return
        syms, last = merge_pair(syms, *pair), step
        yield step, syms


def _changes(pending: list[tuple[str, str]], sequence: list[tuple[str, str]], known: frozenset[tuple[str, str]],
             cut=lambda text: text.split(" ")):
    """Count changes at every step of ``sequence``, after ``pending``, summed over the words of a task.

    Of pairs that lose only, those known count; others need a symbol that the sequence makes.
    """
    steps = {p: i - len(pending) for i, p in enumerate([*pending, *sequence])}
    created = {left + right for left, right in sequence}

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for freq, text in zip(batch.column("freq").to_pylist(), batch.column("syms").to_pylist()):
                before = cut(text)
                for step, after in apply_merges(before, steps):
                    if step >= 0:
                        old, new = pairs_of(before), pairs_of(after)
                        for p in old.keys() | new.keys():
                            if (change := new[p] - old[p]) and (p in known or p[0] in created or p[1] in created):
                                total[p, step] += change * freq
                    before = after
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_pydict({
                "pair": [" ".join(p) for p, _ in keys], "step": pa.array([s for _, s in keys], pa.int32()),
                "delta": pa.array([total[k] for k in keys], pa.int64()), "known": [p in known for p, _ in keys]})

    return run


def _rewritten(sequence: list[tuple[str, str]], version: int):
    """Postings of the words after the merges, and the pairs that they lost."""
    steps = {p: i for i, p in enumerate(sequence)}
    names = [f.split()[0] for f in POSTING.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows = []
            for word, freq, text in zip(*(batch.column(c).to_pylist() for c in ("word", "freq", "syms"))):
                first = after = text.split(" ")
                for _, after in apply_merges(first, steps):
                    pass
                if after is first:
                    continue
                old, new = pairs_of(first), pairs_of(after)
                joined = " ".join(after)
                rows.extend((" ".join(p), word, freq, joined if new[p] else None, version, (new[p] - old[p]) * freq) for p in old.keys() | new.keys())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def _reported(words: DataFrame, changes, least: int) -> dict[tuple[str, str], dict[int, int]]:
    """What ``changes`` says of the words, summed, for known pairs and those that can reach ``least``."""
    rows = words.mapInArrow(changes, "pair string, step int, delta bigint, known boolean")
    gained = F.sum(F.greatest("delta", F.lit(0).cast("bigint")))  # not below what the pair gains in all
    each = rows.groupBy("pair", "known").agg(F.collect_list(F.struct("step", "delta")).alias("at"), gained.alias("gained"))  # an entry a step and task
    out: dict[tuple[str, str], dict[int, int]] = {}
    for r in each.where((F.col("gained") >= least) | F.col("known")).collect():
        at = out.setdefault(tuple(r["pair"].split(" ")), {})
        for x in r["at"]:
            at[x["step"]] = at.get(x["step"], 0) + int(x["delta"])
    return out


def _uncut(text: str) -> list[str]:
    return text[1:-1].split("\t ")


def _cut(*symbols: str) -> str:
    return "".join(f" {s}\t" for s in symbols)


def _pair_totals(batches):
    total: Counter = Counter()
    for batch in batches:
        for freq, text in zip(batch.column("freq").to_pylist(), batch.column("syms").to_pylist()):
            for pair, n in pairs_of(_uncut(text)).items():
                total[pair] += n * freq
    if total:
        yield pa.RecordBatch.from_pydict({"left": [p[0] for p in total], "right": [p[1] for p in total], "n": pa.array(total.values(), pa.int64())})


class WordTable:
    """The distinct words with their symbols, for the first merges, which touch much of all words.

    A symbol is written with a space before and a tab after it (a word holds neither), so a
    merge is a replacement of text that the JVM makes, from left to right.  A round reads the
    words once, without a shuffle, and only those that hold one of its pairs reach Python; every
    ``flush_at`` merges the table is written anew.  It has the steps of :class:`PairIndex` that :func:`learn` takes.
    """

    def __init__(self, words: DataFrame, flush_at: int = 16):
        """``words``: distinct ``word, freq, syms`` (joined by spaces)."""
        self.spark, self.flush_at, self.pending = words.sparkSession, flush_at, []
        marked = F.concat(F.lit(" "), F.replace("syms", F.lit(" "), F.lit("\t ")), F.lit("\t"))
        # a number given here is kept: few bytes of symbols are still much work for the functions above
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.path = self._write(words.select("word", "freq", marked.alias("syms")).repartition(parts, "word"))

    def _write(self, rows: DataFrame) -> str:
        path = scratch_path(self.spark, "bpe-words")
        rows.write.parquet(path)
        return path

    def _stored(self) -> DataFrame:
        return self.spark.read.schema("word string, freq bigint, syms string").parquet(self.path)

    def _now(self) -> DataFrame:
        syms = F.col("syms")
        for left, right in self.pending:
            syms = F.replace(syms, F.lit(_cut(left, right)), F.lit(_cut(left + right)))
        return self._stored().select("word", "freq", syms.alias("syms"))

    def words(self) -> DataFrame:
        """``word, freq, syms`` (joined by spaces) as they stand."""
        return self._now().withColumn("syms", F.expr("replace(substring(syms, 2, length(syms) - 2), '\t ', ' ')"))

    def top(self, k: int) -> list[tuple[str, str, int]]:
        each = self._now().select("freq", "syms").mapInArrow(_pair_totals, "left string, right string, n bigint")
        n = each.groupBy("left", "right").agg(F.sum("n").alias("n"))
        return [(r["left"], r["right"], int(r["n"])) for r in n.orderBy(F.desc("n"), F.asc("left"), F.asc("right")).limit(k).collect()]

    def changes(self, sequence: list[tuple[str, str]], known, least: int) -> dict[tuple[str, str], dict[int, int]]:
        """Per pair its count change at each step, for known pairs and those that can reach ``least``."""
        holds = reduce(or_, [F.contains("syms", F.lit(_cut(*p))) for p in [*self.pending, *sequence]])
        return _reported(self._stored().where(holds).select("freq", "syms"), _changes(self.pending, sequence, frozenset(known), _uncut), least)

    def accept(self, merges: list[tuple[str, str]]) -> None:
        """The merges hold from now on."""
        self.pending.extend(merges)
        if len(self.pending) >= self.flush_at:
            self.path, self.pending = self._write(self._now()), []

    def flush(self) -> None:
        """Nothing waits: :meth:`top` reads the words as they stand."""


class PairIndex:
    """Postings of all words, in folders of the shared checkpoint folder."""

    def __init__(self, words: DataFrame, compact_every: int = 32, flush_at: int = 32):
        """``words``: distinct ``word, freq, syms``."""
        self.spark: SparkSession = words.sparkSession
        self.version, self.compact_every, self.flush_at = 0, compact_every, flush_at
        self.pending: list[tuple[str, str]] = []  # merges that the postings do not show yet
        listed = words.withColumn("_pairs", distinct_pairs("syms")).withColumn("_each", F.array_distinct("_pairs"))
        rows = listed.select("word", "freq", "syms", "_pairs", F.explode("_each").alias("pair")).select(
            "pair", "word", "freq", "syms", F.lit(0).alias("version"),
            (F.size(F.filter("_pairs", lambda x: x == F.col("pair"))) * F.col("freq")).cast("bigint").alias("delta"))
        self.paths = [self._write(rows, whole=True)]

    def _write(self, rows: DataFrame, whole: bool) -> str:
        path = scratch_path(self.spark, "bpe-postings")
        if whole:
            rows = rows.repartitionByRange("pair", "word")
        rows.sortWithinPartitions("pair").write.parquet(path)
        return path

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTING).parquet(*self.paths)

    def counts(self) -> DataFrame:
        """``left, right, n`` of all pairs."""
        n = self.postings().groupBy("pair").agg(F.sum("delta").alias("n")).where("n > 0")
        return n.select(F.substring_index("pair", " ", 1).alias("left"), F.substring_index("pair", " ", -1).alias("right"), "n")

    def top(self, k: int) -> list[tuple[str, str, int]]:
        best = self.counts().orderBy(F.desc("n"), F.asc("left"), F.asc("right")).limit(k).collect()
        return [(r["left"], r["right"], int(r["n"])) for r in best]

    def holding(self, sequence: list[tuple[str, str]]) -> DataFrame:
        """``word, freq, syms``: the words that hold one of the pairs, as they stand."""
        rows = self.postings().where(F.col("pair").isin([" ".join(p) for p in sequence]))
        newest = F.max_by(F.struct("freq", "syms"), F.struct("version", F.col("syms").isNotNull()))
        # a number given here is kept: few bytes of symbols are still much work for the functions above
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        return rows.repartition(parts, "word").groupBy("word").agg(newest.alias("_w")).select("word", "_w.freq", "_w.syms").where("syms IS NOT NULL")

    def changes(self, sequence: list[tuple[str, str]], known, least: int) -> dict[tuple[str, str], dict[int, int]]:
        """Per pair its count change at each step, for known pairs and those that can reach ``least``."""
        return _reported(self.holding([*self.pending, *sequence]), _changes(self.pending, sequence, frozenset(known)), least)

    def accept(self, merges: list[tuple[str, str]]) -> None:
        """The merges hold from now on; words are rewritten once ``flush_at`` of them wait."""
        self.pending.extend(merges)
        if len(self.pending) >= self.flush_at:
            self.flush()

    def flush(self) -> None:
        """Apply the waiting merges, in order, to the words that hold them."""
        if not self.pending:
            return
        self.version += 1
        rows = self.holding(self.pending).mapInArrow(_rewritten(self.pending, self.version), POSTING)
        self.paths.append(self._write(rows, whole=False))
        self.pending = []
        if self.version % self.compact_every == 0:
            self.compact()

    def compact(self) -> None:
        """Write the live postings anew; the older folders are not read any more."""
        newest = F.max_by(F.struct("freq", "syms", "version"), F.col("version"))
        live = self.postings().groupBy("pair", "word").agg(newest.alias("_w"), F.sum("delta").alias("delta"))
        live = live.select("pair", "word", "_w.freq", "_w.syms", "_w.version", "delta").where("syms IS NOT NULL")
        self.paths = [self._write(live, whole=True)]


def _key(pair: tuple[str, str], n: int) -> tuple:
    return (-n, *pair)


class BestPairs:
    """The best pairs with exact counts: all that come before ``floor`` in (count descending, left, right)."""

    def __init__(self, index: PairIndex, size: int):
        self.index, self.size = index, size
        self.refresh()

    def refresh(self) -> None:
        self.index.flush()
        top = self.index.top(self.size)
        self.counts = {(left, right): n for left, right, n in top}
        self.floor = _key(top[-1][:2], top[-1][2]) if len(top) == self.size else (0,)
        self.fresh = True

    def _best(self, counts: dict) -> tuple[str, str] | None:
        best = min(((-n, *p) for p, n in counts.items() if n > 0), default=None)
        return None if best is None or best > self.floor else best[1:]

    def guess(self, most: int, symbols: set[str]) -> list[tuple[str, str]]:
        """Pairs in their present order, without those that a merge before them may change."""
        out: list[tuple[str, str]] = []
        no_left: set[str] = set()
        no_right: set[str] = set()
        for (left, right), n in sorted(self.counts.items(), key=lambda x: _key(*x)):
            if len(out) >= most or n <= 0 or _key((left, right), n) > self.floor:
                break
            if left in no_left or right in no_right:
                continue
            out.append((left, right))
            if left + right in symbols or any(left + right == a + b for a, b in out[:-1]):
                break  # a symbol that exists already: counts of its pairs are not all in the list
            # what the merge can change: pairs that begin with ``right`` or end with ``left``
            no_left.add(right)
            no_right.add(left)
            if left == right:
                no_left.add(left)
                no_right.add(left)
        return out

    def replay(self, sequence: list[tuple[str, str]], changes: dict[tuple[str, str], dict[int, int]], check: bool = True) -> list[tuple[str, str, int]]:
        """The longest prefix whose steps each take the best pair, with the counts then; the list is brought up to date."""
        done = []
        by_step: dict[int, list] = {}
        for pair, at in changes.items():
            for step, delta in at.items():
                by_step.setdefault(step, []).append((pair, delta))
        for step, pair in enumerate(sequence):
            n = self.counts.get(pair, 0)
            if n <= 0 or (check and self._best(self.counts) != pair):
                break
            done.append((*pair, n))
            for other, delta in by_step.get(step, []):
                self.counts[other] = self.counts.get(other, 0) + delta
        self.counts = {p: n for p, n in self.counts.items() if n > 0 and _key(p, n) <= self.floor}
        self.fresh = False
        return done


def learn(index: PairIndex, n_merges: int, alphabet: set[str], candidates: int = 1024, most: int = 64, exact: bool = True
          ) -> tuple[list[tuple[str, str, int]], int]:
    """``(left, right, n)`` of each merge in the order of a one-at-a-time learner, and the number of rounds."""
    best = BestPairs(index, candidates)
    symbols = set(alphabet)
    merges: list[tuple[str, str, int]] = []
    rounds, width = 0, 8
    while len(merges) < n_merges:
        sequence = best.guess(min(width, n_merges - len(merges)), symbols)
        if not sequence:
            if best.fresh:
                break
            best.refresh()
            continue
        rounds += 1
        changes = index.changes(sequence, best.counts, -best.floor[0] if best.floor != (0,) else 1)
        done = best.replay(sequence, changes, exact)
        width = max(8, min(most, 2 * len(done)))  # as many as may hold
        merges.extend(done)
        index.accept([m[:2] for m in done])
        made = [left + right for left, right, _ in done]
        if len(symbols.union(made)) < len(symbols) + len(made):
            best.refresh()  # a symbol that there was before
        symbols.update(made)
    return merges, rounds
