"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word's subwords are the 1- to 4-grams of its letter runs, with the run's
ends marked; each is hashed into a table of embeddings.  A text is the average
of the embeddings of all its subwords, and a linear layer with softmax gives
the language.  Both are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows.  As embedding and layer are linear, tasks use
one table of their product, and score each distinct word of a slice once.

Scores are calibrated by a temperature fitted on rows kept out of training; a
text is rejected if it has no letter or its score is below the threshold that
right answers on those rows reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.ragged import mix64, offsets_of, row_slices, split_words

UNDETERMINED = "und"
#: Text bytes whose subwords a task lists at a time; a new word has about 35 of them.
SUBWORD_BYTES = 2 << 20
BUCKETS = 1 << 15
DIMENSIONS = 16
GRAMS = (1, 2, 3, 4)
#: Bound on the labelled rows that are fitted on, in all languages together.
FIT_ROWS = 4000
EPOCHS = 12
BATCH = 16
RATE = 0.5
#: Of every so many sampled rows, one is kept for calibration.
KEEP_OUT = 5
#: Share of right answers, among the rows kept out, that the threshold may reject.
LOST = 0.0005


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of each word: flat buckets and offsets."""
    text = "\n".join(words).lower() + "\n"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, back = np.unique(code, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds])[back]
    owner = np.cumsum(code == 10) - (code == 10)
    # a run of letters keeps one mark at each side; all else is dropped
    code = np.concatenate([[1], np.where(letter, code, 1)]).astype(np.uint64)
    letter = np.concatenate([[False], letter])
    owner = np.concatenate([[0], owner])
    found, owners = [], []
    for n in GRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        if n == 1:
            good = letter.copy()
        else:
            good = np.ones(m, bool)
            for k in range(1, n - 1):
                good &= letter[k:k + m]
            if n == 2:
                good &= letter[:m] | letter[1:]
        value = np.full(m, n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + code[k:k + m]
        at = np.flatnonzero(good)
        found.append((mix64(value[at]) % np.uint64(BUCKETS)).astype(np.int32))
        # the letters of a gram are in one word; the middle or the end that is a letter names it
        inner = at + (1 if n > 2 else 0)
        if n == 2:
            inner = np.where(letter[at], at, at + 1)
        owners.append(owner[inner])
    bucket, own = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(words))[:len(words)]
    return bucket[order], offsets_of(counts)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def _document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_slices(batches, "text", SUBWORD_BYTES):
        codes, starts, words = split_words(batch.column("text"))
        grams, offsets = subwords(words.to_pylist())
        rows = []
        for i in range(batch.num_rows):
            use, times = np.unique(codes[starts[i]:starts[i + 1]], return_counts=True)
            lengths = offsets[use + 1] - offsets[use]
            flat = np.concatenate([grams[offsets[u]:offsets[u + 1]] for u in use]) if len(use) else np.zeros(0, np.int32)
            weight = np.bincount(flat, weights=np.repeat(times, lengths), minlength=1)
            at = np.flatnonzero(weight)
            rows.append((at.astype("<u2").tobytes(), (weight[at] / max(weight.sum(), 1)).astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array([r[0] for r in rows], pa.binary()),
             pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "lang", "at", "weight"])


def sample_features(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> list:
    """Subword averages of about ``fit_rows`` labelled rows, the same number of each language.

    Rows are picked by a hash of their id and text; a language with fewer rows gives all
    of them.  Only this bounded sample reaches the driver.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    each = max(fit_rows // len(counts), 1)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(draw < share[F.col("lang")])
    return picked.mapInArrow(_document_features, "doc_id long, lang string, at binary, weight binary").collect()


def fit(sample: list, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, seed: int = 7) -> LanguageModel | None:
    """Train on collected features; None if there is nothing to learn from."""
    sample = sorted((r for r in sample if len(r["at"])), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], len(r["at"]), r["at"], r["weight"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return None
    y = np.array([languages.index(r["lang"]) for r in sample])
    xs = [(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["weight"], "<f4")) for r in sample]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(xs))
    kept_out = order[::KEEP_OUT] if len(xs) >= 20 * KEEP_OUT else order[:0]
    train = np.setdiff1d(order, kept_out)
    k = len(languages)
    emb = rng.normal(0, 1 / np.sqrt(dimensions), (BUCKETS, dimensions))
    lin, bias = np.zeros((dimensions, k)), np.zeros(k)
    # rare languages count as much as frequent ones
    weight = len(train) / (k * np.maximum(np.bincount(y[train], minlength=k), 1))
    steps, done = epochs * max(1, -(-len(train) // BATCH)), 0
    for _ in range(epochs):
        mixed = rng.permutation(train)
        for lo in range(0, len(mixed), BATCH):
            rows = mixed[lo:lo + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = np.stack([xs[i][1] @ emb[xs[i][0]] for i in rows])
            z = hidden @ lin + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows]][:, None]
            back = p @ lin.T
            lin -= rate * hidden.T @ p
            bias -= rate * p.mean(axis=0)
            for j, i in enumerate(rows):  # a text's mean moves its subwords; scaled, as each has a small share
                emb[xs[i][0]] -= (rate * 20) * xs[i][1][:, None] * back[j]
    table = emb @ lin
    model = LanguageModel(languages, table, bias, 1.0, 0.0)
    held = kept_out if len(kept_out) else train
    z = np.stack([xs[i][1] @ table[xs[i][0]] for i in held]) + bias
    right = z.argmax(axis=1) == y[held]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]))

    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
    model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    best = model.scores(z - bias, np.ones(len(held))).max(axis=1)
    if right.any():
        model.threshold = float(min(np.quantile(best[right], LOST), 0.5))
    return model


def predict(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for every row, from whole texts.

    A text that is null or has no letter is ``und`` with score 0 and not
    accepted, as is every text if there is no model.
    """
    named = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shipped = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the input

    def run(batches):
        for batch in row_slices(batches, "text", SUBWORD_BYTES):
            names, score, accepted = _predicted(batch.column("text"), shipped.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, score, accepted], ["doc_id", "lang_pred", "score", "accepted"])

    return named.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def accepted(df: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows, whole, whose text is accepted (see :func:`predict`)."""
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def accepts(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        parts = [_predicted(b.column("text"), shipped.value)[2] for b in row_slices(iter([batch]), "text", SUBWORD_BYTES)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())

    return df.where(accepts(F.col(f"`{text_col}`").cast("string")))


def _predicted(column: pa.Array, m: LanguageModel | None) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Language, score and acceptance of each text."""
    names = np.array([*(m.languages if m else []), UNDETERMINED], object)
    codes, starts, words = split_words(column)
    grams, offsets = subwords(words.to_pylist())
    size = (offsets[1:] - offsets[:-1]).astype(np.float64)
    n = _sums(size[codes], starts)
    best, score = np.full(len(column), len(names) - 1), np.zeros(len(column))
    if m:
        per_word = np.stack([_sums(m.table[grams, j], offsets) for j in range(len(m.languages))], axis=1)
        total = np.stack([_sums(per_word[codes, j], starts) for j in range(per_word.shape[1])], axis=1)
        p = m.scores(total, n)
        some = n > 0
        best[some], score[some] = p.argmax(axis=1)[some], p.max(axis=1)[some]
    fine = (n > 0) & (score >= (m.threshold if m else 2.0))
    return pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(fine)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row of a ragged array, each row by itself (no running total over rows)."""
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          fit_rows: int = FIT_ROWS) -> LanguageModel | None:
    """Learn from the text and non-null language of the rows that are not held out."""
    rows = df.where(~held_out(id_col)).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"))
    return fit(sample_features(rows, fit_rows))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             fit_rows: int = FIT_ROWS) -> DataFrame:
    """Train, then predict every row: ``doc_id, held_out, lang_pred, score, accepted``.

    A row with a null id is not held out.  Repeated rows are each predicted;
    an empty table gives an empty one; other columns are ignored, whatever their names.
    Of languages with equal scores the first in code point order is predicted.
    """
    model = train(df, id_col, text_col, lang_col, fit_rows)
    out = predict(df, model, id_col, text_col)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
