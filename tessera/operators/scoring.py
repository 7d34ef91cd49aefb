"""Batch scoring of a text table with a user-supplied predictor.

The predictor factory runs once per task (outside the batch loop), so a
model is loaded once per Python worker task, not per row.  A row whose
prediction raises yields ``status='error'`` and the error text; the job
does not fail.  If the predictor offers ``predict_batch(list)``, whole Arrow
batches are passed to it and only a failing batch is retried row by row.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.text import n_words


def _typed(value, kind):
    """The value, if the output column can hold it; a wrong type is that row's error."""
    if kind is not None and value is not None and not isinstance(value, kind):
        raise TypeError(f"prediction is {type(value).__name__}")
    return value


#: Python values that an output column of a simple type takes.
PYTHON_TYPES = {"string": str, "int": int, "bigint": int, "double": (float, int), "float": (float, int), "boolean": bool,
                "array": (list, tuple)}


def token_batches(lengths: list[int], budget: int) -> list[list[int]]:
    """Row numbers in batches whose padded size, rows x longest row, is at most ``budget`` (or one row), shortest rows first."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if out and (len(out[-1]) + 1) * max(lengths[i], 1) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _score_batches(factory: Callable, text_col: str, out_col: str, kind=None, max_len: int | None = None, budget: int | None = None):
    def run(batches):
        predictor = factory()
        batch_fn = getattr(predictor, "predict_batch", None)
        call = predictor if callable(predictor) else getattr(predictor, "predict", None)

        def one(text):
            try:
                got = call(text) if call is not None else next(iter(batch_fn([text])))
                return _typed(got, kind), "ok", None
            except Exception as e:  # noqa: BLE001 - reported per row
                return None, "error", f"{type(e).__name__}: {e}"

        def together(texts):
            if batch_fn is not None:
                try:
                    outs = list(batch_fn(texts))
                    if len(outs) != len(texts):
                        raise ValueError(f"{len(outs)} predictions for {len(texts)} texts")
                    return [(_typed(o, kind), "ok", None) for o in outs]
                except Exception:  # fall back to rows; the failing row is reported
                    pass
            return [one(t) for t in texts]

        for pdf in batches:
            texts = pdf[text_col].tolist()
            results: list = [None] * len(texts)
            rows = list(range(len(texts)))
            if LENGTH in pdf:
                lengths = [0 if n != n else int(n) for n in pdf[LENGTH].tolist()]  # null has no length
                if max_len is not None:
                    for i in rows:
                        if lengths[i] > max_len:
                            results[i] = (None, "error", f"ValueError: {lengths[i]} tokens, at most {max_len}")
                    rows = [i for i in rows if results[i] is None]
                groups = [rows] if budget is None else [[rows[k] for k in g] for g in token_batches([lengths[i] for i in rows], budget)]
            else:
                groups = [rows]
            for group in groups:
                for i, result in zip(group, together([texts[i] for i in group]) if group else []):
                    results[i] = result
            pdf = pdf.drop(columns=[LENGTH]) if LENGTH in pdf else pdf.copy()
            pdf[out_col], pdf["status"], pdf["error"] = zip(*results) if results else ((), (), ())
            yield pdf

    return run


#: Column that a row's length travels in to the predictor's task.
LENGTH = "__tokens"


def batch_predict(df: DataFrame, predictor_factory: Callable, text_col: str = "text", out_col: str = "prediction", out_type=StringType(),
                  length: Column | None = None, max_len: int | None = None, token_budget: int | None = None) -> DataFrame:
    """``df`` plus ``prediction``, ``status`` and ``error`` columns (``mapInPandas``).

    ``length`` is the number of tokens of a row, specials included (:func:`word_tokens`, or the size of its
    ids).  A row longer than ``max_len`` (the model's positions) does not reach the predictor: that
    is its error.  ``token_budget`` cuts the batches handed to ``predict_batch`` so that rows x longest row stays
    within it, with rows of like length together; each row keeps its place.
    """
    if length is None and (max_len is not None or token_budget is not None):
        raise ValueError("a limit on tokens needs the length of a row")
    schema = StructType(
        list(df.schema.fields)
        + [
            StructField(out_col, out_type, True),
            StructField("status", StringType(), False),
            StructField("error", StringType(), True),
        ]
    )
    rows = df if length is None else df.withColumn(LENGTH, length.cast("int"))
    kind = PYTHON_TYPES.get(out_type.simpleString().split("<")[0])
    return rows.mapInPandas(_score_batches(predictor_factory, text_col, out_col, kind, max_len, token_budget), schema)


def word_tokens(text_col: str, specials: int = 1) -> Column:
    """Length of a request in words, with the specials that :func:`inference_source` adds."""
    return F.coalesce(n_words(text_col), F.lit(0)) + specials


class ReverseWords:
    """A small deterministic predictor used by the query catalog and tests:
    the words of the text in reverse order; empty text is an error."""

    def __call__(self, text):
        if text is None or not text.split():
            raise ValueError("empty input")
        return " ".join(reversed(text.split()))


def reverse_words_factory():
    return ReverseWords()
