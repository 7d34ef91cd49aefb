"""M1-M7: character and word error rates, BLEU, evaluation rows and scalars.

Edit distances are row-local, followed by one partial aggregate: an Arrow function
measures all pairs of a batch that differ side by side, bit-parallel.  BLEU's clipped counts are row-local as well: one Arrow function
numbers the n-grams of a batch, so no n-gram is shuffled and
rows that repeat an id cannot mix; only one row of sums a group and task is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from tessera.functions.text import split_words, tokenize_13a
from tessera.operators.sequences import coded, distances, ngram_matches, offsets_of

# Words and characters of a batch that are worked on at a time.
BATCH_WORDS, BATCH_CHARS = 1 << 20, 1 << 22


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _text(col) -> Column:
    return F.coalesce(_c(col), F.lit(""))


def _groups(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows with lengths of about ``most`` in all."""
    part = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]


def _word_groups(*columns: pa.Array):
    """The columns' rows in groups of about ``BATCH_WORDS`` words."""
    for lo, hi in _groups(sum(np.diff(np.asarray(c.offsets)) for c in columns), BATCH_WORDS):
        yield [c.slice(lo, hi - lo) for c in columns]


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a string column without nulls."""
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    return flat, offsets_of(np.asarray(pc.utf8_length(texts)).astype(np.int64))


@F.arrow_udf(IntegerType())
def _char_distance(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """Edits of the pairs given over code points; null where there is none."""
    some = np.flatnonzero(np.asarray(pc.and_(hyp.is_valid(), ref.is_valid())))
    h, r = hyp.take(pa.array(some)), ref.take(pa.array(some))
    lengths = np.asarray(pc.utf8_length(h)).astype(np.int64) + np.asarray(pc.utf8_length(r))
    out = [distances(_points(h.slice(lo, hi - lo)), _points(r.slice(lo, hi - lo))) for lo, hi in _groups(lengths, BATCH_CHARS)]
    edits, none = np.zeros(len(hyp), np.int32), np.ones(len(hyp), bool)
    none[some] = False
    if out:
        edits[some] = np.concatenate(out)
    return pa.array(edits, mask=none)


@F.arrow_udf(IntegerType())
def _word_distance(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """Word edits of each row; the distinct words of a batch are numbered once."""
    out = [distances(*coded(h, r)) for h, r in _word_groups(hyp, ref)]
    return pa.array(np.concatenate(out) if out else [], pa.int32())


def char_edits(hyp, ref) -> Column:
    """Edits from hypothesis to reference over code points; null counts as empty.  Equal texts stay in the JVM."""
    h, r = _text(hyp), _text(ref)
    return F.coalesce(_char_distance(F.when(h != r, h), F.when(h != r, r)), F.lit(0))


def _group(by) -> list[str]:
    return list(by or [])


def cer(df: DataFrame, hyp: str = "hyp", ref: str = "ref", by=None) -> DataFrame:
    """M1: CER = sum(character edits) / sum(reference characters), arguments
    (prediction, target).  An empty corpus gives NULL."""
    return error_rates(df, hyp, ref, by).select(*_group(by), "char_edits", "ref_chars", "cer")


def wer(df: DataFrame, hyp: str = "hyp", ref: str = "ref", by=None, tokenize=split_words) -> DataFrame:
    """M2: WER = sum(word edits) / sum(reference words)."""
    return error_rates(df, hyp, ref, by, tokenize).select(*_group(by), "word_edits", "ref_words", "wer")


def error_rates(df: DataFrame, hyp: str = "hyp", ref: str = "ref", by=None, tokenize=split_words) -> DataFrame:
    """M1 + M2 in one pass: character and word edits per row, one aggregate.

    Characters: one Arrow function measures the pairs of a batch that differ.  Words: one Arrow function
    numbers the words of a batch and measures all rows side by side.
    """
    g = _group(by)
    return _with_rates(_texts(df, hyp, ref, g, tokenize).select(*g, *_edits()).groupBy(*g).agg(*_edit_sums()))


def _texts(df: DataFrame, hyp: str, ref: str, g: list[str], tokenize) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.select(*g, _text(hyp).alias("_h"), _text(ref).alias("_r"),
                     F.coalesce(tokenize(_c(hyp)), empty).alias("_hw"), F.coalesce(tokenize(_c(ref)), empty).alias("_rw"))


def _edits() -> list[Column]:
    return [char_edits("_h", "_r").alias("_ce"), F.length("_r").alias("_cn"), _word_distance("_hw", "_rw").alias("_we"), F.size("_rw").alias("_wn")]


def _edit_sums() -> list[Column]:
    names = {"_ce": "char_edits", "_cn": "ref_chars", "_we": "word_edits", "_wn": "ref_words"}
    return [F.sum(c).cast("bigint").alias(name) for c, name in names.items()]


def _with_rates(sums: DataFrame) -> DataFrame:
    for edits, length, rate in (("char_edits", "ref_chars", "cer"), ("word_edits", "ref_words", "wer")):
        sums = sums.withColumn(rate, F.try_divide(F.col(edits).cast("double"), F.col(length).cast("double")))
    return sums


def _clipped(n_max: int):
    """Per row: clipped and total n-gram counts for each n, hypothesis length, closest reference length."""

    def group(columns: list) -> pa.Array:
        hyp, *refs = coded(*columns)
        clipped, total = ngram_matches(hyp, refs, n_max)
        own = np.diff(hyp[1])
        lengths = np.sort(np.stack([np.diff(o) for _, o in refs]), axis=0)  # the shorter one on ties
        closest = np.take_along_axis(lengths, np.abs(lengths - own).argmin(axis=0)[None], axis=0)[0]
        flat = np.column_stack([clipped, total, own, closest])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel(), pa.int64()))

    @F.arrow_udf(ArrayType(LongType()))
    def stats(*texts: pa.Array) -> pa.Array:
        out = [group(columns) for columns in _word_groups(*texts)]
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    return stats


def ngram_stats(df: DataFrame, hyp: str, refs: list[str], n_max: int = 4, by=None, id_col: str | None = None,
                tokenize=split_words) -> DataFrame:
    """Clipped and total n-gram counts per (group, n) plus corpus lengths.

    Output: ``by..., c1..cN, t1..tN, hyp_len, ref_len`` (``ref_len`` is the
    closest reference length per row, the shorter one on ties).  NULL groups
    are groups; ``id_col`` is not needed, as rows are counted one by one.
    """
    g = _group(by)
    empty = F.array().cast("array<string>")
    tokens = [F.coalesce(tokenize(_c(c)), empty) for c in [hyp, *refs]]
    rows = df.select(*g, _clipped(n_max)(*tokens).alias("_s"))
    return rows.groupBy(*g).agg(*_ngram_sums(n_max))


def _ngram_sums(n_max: int) -> list[Column]:
    names = [*(f"c{n}" for n in range(1, n_max + 1)), *(f"t{n}" for n in range(1, n_max + 1)), "hyp_len", "ref_len"]
    return [F.coalesce(F.sum(F.get("_s", F.lit(i))), F.lit(0)).cast("bigint").alias(c) for i, c in enumerate(names)]


def bleu_from_stats(n_max: int = 4) -> Column:
    """Uniform-weight BLEU without smoothing; 0 when any clipped count is 0."""
    c = [F.col(f"c{n}").cast("double") for n in range(1, n_max + 1)]
    t = [F.col(f"t{n}").cast("double") for n in range(1, n_max + 1)]
    any_zero = F.lit(False)
    for ci in c:
        any_zero = any_zero | (ci <= 0)
    logp = sum((F.log(ci / ti) for ci, ti in zip(c, t)), F.lit(0.0)) / F.lit(float(n_max))
    hl, rl = F.col("hyp_len").cast("double"), F.col("ref_len").cast("double")
    bp = F.when(hl > rl, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - rl / hl))
    return F.when(any_zero, F.lit(0.0)).otherwise(bp * F.exp(logp))


def bleu(df: DataFrame, hyp: str = "hyp", refs=("ref",), n_max: int = 4, by=None, id_col: str | None = None,
         tokenize=split_words) -> DataFrame:
    """M3: corpus BLEU (n = 1..4, clipped counts, brevity penalty, no smoothing)."""
    refs = [refs] if isinstance(refs, str) else list(refs)
    st = ngram_stats(df, hyp, refs, n_max, by, id_col, tokenize)
    return st.withColumn("bleu", bleu_from_stats(n_max))


def sacre_bleu_from_stats(n_max: int = 4) -> Column:
    """Corpus BLEU on a 0-100 scale with exponential smoothing: the k-th
    order without a match gets precision ``100 / (2^k * total)``; an order
    without any n-gram contributes log(0), taken as -9999999999."""
    hl, rl = F.col("hyp_len").cast("double"), F.col("ref_len").cast("double")
    bp = F.when(hl < rl, F.when(hl > 0, F.exp(F.lit(1.0) - rl / hl)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0))
    zeros = F.lit(0)
    logs = []
    for n in range(1, n_max + 1):
        cn, tn = F.col(f"c{n}").cast("double"), F.col(f"t{n}").cast("double")
        miss = (cn == 0) & (tn > 0)
        zeros = zeros + miss.cast("int")
        p = (
            F.when(tn == 0, F.lit(0.0))
            .when(cn == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros.cast("double")) * tn))
            .otherwise(F.lit(100.0) * cn / tn)
        )
        logs.append(F.when(p == 0, F.lit(-9999999999.0)).otherwise(F.log(p)))
    score = bp * F.exp(sum(logs, F.lit(0.0)) / F.lit(float(n_max)))
    any_match = F.lit(False)
    for n in range(1, n_max + 1):
        any_match = any_match | (F.col(f"c{n}") > 0)
    return F.when(any_match, score).otherwise(F.lit(0.0))


def corpus_bleu(df: DataFrame, hyp: str = "hyp", refs=("ref",), tokenize: str = "13a", n_max: int = 4, by=None,
                id_col: str | None = None) -> DataFrame:
    """M4: the offline scorer's corpus BLEU (13a tokens, exponential smoothing)."""
    refs = [refs] if isinstance(refs, str) else list(refs)
    if tokenize == "13a":
        tok = lambda c: split_words(tokenize_13a(c))
    elif tokenize == "char":
        tok = lambda c: F.filter(F.split(c, ""), lambda x: x != F.lit(" "))
    else:
        tok = split_words
    st = ngram_stats(df, hyp, refs, n_max, by, id_col, tok)
    return st.withColumn("bleu", sacre_bleu_from_stats(n_max))


def eval_rows(df: DataFrame, src: str = "src_text", expected: str = "tgt_text", predicted: str = "predicted",
              key: str | None = None, with_text: bool = True) -> DataFrame:
    """M5: evaluation rows ``source / expected / predicted`` and the printed text."""
    cols = [key] if key else []
    out = df.select(*cols, F.col(src).alias("source"), F.col(expected).alias("expected"), F.col(predicted).alias("predicted"))
    if with_text:
        out = out.withColumn(
            "message",
            F.format_string("Source: %s\nExpected: %s\nPredicted: %s\n", F.col("source"), F.col("expected"), F.col("predicted")),
        )
    return out


def eval_steps(df: DataFrame, step_col: str = "step", every: int = 500) -> DataFrame:
    """M6: the steps that trigger validation (every ``every`` steps, step 0 included)."""
    return df.where(F.col(step_col) % F.lit(int(every)) == 0)


def validation_scalars(df: DataFrame, step_col: str = "step", hyp: str = "hyp", ref: str = "ref",
                       mode: str = "corpus", order_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """M7: ``(tag, step, value)`` for validation/cer, /wer, /bleu per step.

    ``mode="corpus"`` scores all rows of a step; ``mode="last"`` only the last
    example of each step (by ``order_col``), as the reference does.
    """
    d = df
    if mode == "last":
        o = order_col or id_col
        picked = df.groupBy(step_col).agg(F.max_by(F.struct(F.col(hyp).alias("_hyp"), F.col(ref).alias("_ref"), F.col(o).alias("_o")), F.col(o)).alias("_x"))
        d = picked.select(step_col, F.col("_x._hyp").alias(hyp), F.col("_x._ref").alias(ref), F.col("_x._o").alias("_o"))
    # one pass: the words of a row serve its edits and its n-grams
    rows = _texts(d, hyp, ref, [step_col], split_words).select(step_col, *_edits(), _clipped(4)("_hw", "_rw").alias("_s"))
    j = _with_rates(rows.groupBy(step_col).agg(*_edit_sums(), *_ngram_sums(4))).withColumn("bleu", bleu_from_stats(4))
    return j.select(
        F.expr("stack(3, 'validation/cer', cer, 'validation/wer', wer, 'validation/bleu', bleu) as (tag, value)"),
        F.col(step_col).cast("bigint").alias("step"),
    ).select("tag", "step", "value")
