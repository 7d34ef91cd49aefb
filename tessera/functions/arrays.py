"""Array Column expressions: example arrays, masks, strip and stop rules, vectors.

All are higher-order Spark SQL functions evaluated inside whole-stage codegen
(or the interpreted lambda path); none leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import EOS_ID, PAD_ID, SOS_ID


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _i(v) -> Column:
    return F.lit(int(v)) if isinstance(v, int) else _c(v)


def _pads(n: Column, pad: int) -> Column:
    return F.array_repeat(F.lit(int(pad)), F.greatest(n, F.lit(0)))


def encoder_input(ids, seq_len: int, sos=SOS_ID, eos=EOS_ID, pad=PAD_ID) -> Column:
    """SOS + ids + EOS + PADs up to ``seq_len``."""
    ids = _c(ids)
    n = F.lit(seq_len) - F.size(ids) - 2
    return F.concat(F.array(F.lit(sos)), ids, F.array(F.lit(eos)), _pads(n, pad))


def decoder_input(ids, seq_len: int, sos=SOS_ID, pad=PAD_ID) -> Column:
    """SOS + ids + PADs (shifted right)."""
    ids = _c(ids)
    n = F.lit(seq_len) - F.size(ids) - 1
    return F.concat(F.array(F.lit(sos)), ids, _pads(n, pad))


def label(ids, seq_len: int, eos=EOS_ID, pad=PAD_ID) -> Column:
    """Ids + EOS + PADs (shifted left)."""
    ids = _c(ids)
    n = F.lit(seq_len) - F.size(ids) - 1
    return F.concat(ids, F.array(F.lit(eos)), _pads(n, pad))


def pad_mask(arr, pad=PAD_ID) -> Column:
    """1 where the position is not padding."""
    return F.transform(_c(arr), lambda x: (x != F.lit(pad)).cast("int"))


def causal_mask(n) -> Column:
    """E5: lower-triangular ``n x n`` matrix of 0/1 (``j <= i``)."""
    n = _i(n)
    rng = F.sequence(F.lit(0), n - 1)
    return F.when(n <= 0, F.array().cast("array<array<int>>")).otherwise(
        F.transform(rng, lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: (j <= i).cast("int")))
    )


def decoder_valid_len(ids) -> Column:
    """E6 compact form: number of leading non-pad decoder positions (tgt_len + 1)."""
    return F.size(_c(ids)) + 1


def decoder_mask(arr, pad=PAD_ID) -> Column:
    """E6 expanded: ``mask[i][j] = (j <= i) AND arr[j] != pad`` (``seq_len^2`` ints per row)."""
    a = _c(arr)
    n = F.size(a)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda j: ((j <= i) & (F.get(a, j) != F.lit(pad))).cast("int"),
        ),
    )


def inference_source(ids, eos=EOS_ID) -> Column:
    """Ids + EOS, no SOS and no padding (the interactive path)."""
    return F.concat(_c(ids), F.array(F.lit(eos)))


def strip_specials(ids, sos=SOS_ID, eos=EOS_ID) -> Column:
    """Drop one leading SOS, then cut at the first EOS (exclusive)."""
    a = _c(ids)
    s = F.when(F.get(a, 0) == F.lit(sos), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    p = F.array_position(s, F.lit(eos))
    return F.when(p > 0, F.slice(s, 1, (p - 1).cast("int"))).otherwise(s)


def apply_stop(ids, max_len, eos=EOS_ID) -> Column:
    """Keep a generated sequence (SOS first) up to and including the first
    EOS, and at most ``max_len`` items counting SOS; at least the SOS stays."""
    a = _c(ids)
    first_eos = F.nullif(F.array_position(a, F.lit(eos)), F.lit(0)).cast("int")
    keep = F.least(F.coalesce(first_eos, F.size(a)), _i(max_len))
    return F.slice(a, 1, F.greatest(keep, F.lit(1)))


def position_features(pos, d: int) -> Column:
    """Sinusoidal features, ``sin`` in even and ``cos`` in odd slots:
    slot k uses angle ``pos * 10000^(-(k - k%2)/d)``."""
    p = _c(pos).cast("double")
    scale = -math.log(10000.0) / d

    def slot(k):
        even = k - (k % 2)
        ang = p * F.exp(even.cast("double") * F.lit(scale))
        return F.when(k % 2 == 0, F.sin(ang)).otherwise(F.cos(ang))

    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), slot)


def scale_vector(arr, factor) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(_c(arr), lambda x: x.cast("double") * f)


def vector_mean(arr) -> Column:
    a = _c(arr)
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.size(a).cast("double"))


def standardize(arr, alpha: float = 1.0, bias: float = 0.0, eps: float = 1e-6) -> Column:
    """``alpha * (x - mean) / (std + eps) + bias`` with the sample std
    (n - 1); eps is added to the std, not the variance.

    The row's statistics enter the element lambda as a ``zip_with`` argument,
    which is evaluated once per row (an outer expression inside the lambda
    body would be re-evaluated for every element)."""
    a = _c(arr)
    m = vector_mean(a)
    moments = F.array_repeat(F.struct(m.alias("m")), F.size(a))
    centred = F.zip_with(a, moments, lambda x, st: x.cast("double") - st["m"])
    ss = F.aggregate(centred, F.lit(0.0), lambda acc, d: acc + d * d)
    std = F.sqrt(F.try_divide(ss, (F.size(a) - 1).cast("double")))
    scale = F.array_repeat(F.struct(std.alias("s")), F.size(a))
    return F.zip_with(centred, scale, lambda d, st: F.lit(alpha) * d / (st["s"] + F.lit(eps)) + F.lit(bias))


def round_array(arr, digits: int = 6) -> Column:
    return F.transform(_c(arr), lambda x: F.round(x, digits))


def join_ints(arr, sep: str = ",") -> Column:
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), sep)
