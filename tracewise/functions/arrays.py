"""Array-valued column expressions (all JVM side, no Python UDF).

Vectors arrive as ``ARRAY<FLOAT>``; arithmetic is done in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x):
    return x.cast("double")


# A lambda body is evaluated once per element, so a per-row value used in it
# (the max, the sum) must not be written inside the lambda: it would be
# recomputed for every element.  ``_with_scalar`` passes such a value in as
# a second array argument, evaluated once per row.
def _with_scalar(v: Column, scalar: Column, fn) -> Column:
    return F.zip_with(v, F.array_repeat(scalar, F.size(v)), fn)


def array_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + _d(x))


def softmax(v: Column) -> Column:
    """exp(x - max) / sum(exp(x - max)), flattened vector (V1).  O(n) per row."""
    e = _with_scalar(v, _d(F.array_max(v)), lambda x, m: F.exp(_d(x) - m))
    return _with_scalar(e, array_sum(e), lambda x, s: x / s)


def softmax_extremes(v: Column) -> tuple[Column, Column]:
    """(max, min) softmax probability of a logit vector (V6).  O(n) per row."""
    m = _d(F.array_max(v))
    denom = array_sum(_with_scalar(v, m, lambda x, mm: F.exp(_d(x) - mm)))
    return (F.lit(1.0) / denom, F.exp(_d(F.array_min(v)) - m) / denom)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + _d(x) * _d(x)))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity with each norm floored at ``eps`` (V3).

    Null when the sizes differ (the reference fails on that input).
    """
    val = dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))
    return F.when(F.size(a) == F.size(b), val)


def wasserstein_sorted(a_sorted: Column, b_sorted: Column) -> Column:
    """1-D Wasserstein distance of two equal-size samples given sorted (V2).

    For equal sizes the CDF form reduces to mean |a(i) - b(i)|.  Null when
    the sizes differ (use ``wasserstein_long`` for that case).
    """
    diff = F.aggregate(F.zip_with(a_sorted, b_sorted, lambda x, y: F.abs(_d(x) - _d(y))),
                       F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a_sorted) == F.size(b_sorted), diff / F.size(a_sorted))


def concentration(v: Column) -> Column:
    """abs(2 * sum(cumsum(sorted v)) / (n * sum v) - 1), 0 when sum is 0 (V8).

    sum(cumsum(x_(1..n))) = sum_i (n - i + 1) x_(i) for ascending x, so one
    aggregate over the sorted array with its index suffices.
    """
    s = F.array_sort(v)
    n = F.size(s)
    total = array_sum(s)
    # sum_i (n - i) x_i (0-based i) = n * total - sum_i i * x_i
    weighted = n * total - F.aggregate(
        F.transform(s, lambda x, i: _d(x) * i), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(total == 0, F.lit(0.0)).otherwise(
        F.abs(F.lit(2.0) * weighted / (n * total) - F.lit(1.0)))


def head_mean(v: Column, n_heads: Column | int) -> Column:
    """Mean over heads of a row-major [heads, m] vector -> length m."""
    h = F.lit(n_heads) if isinstance(n_heads, int) else n_heads
    m = (F.size(v) / h).cast("int")
    # sum the heads slice by slice: element j of head k sits at k * m + j
    return F.transform(
        F.aggregate(F.when(h > 1, F.sequence(F.lit(1), F.greatest(h - 1, F.lit(1)))).otherwise(F.array().cast("array<int>")),
                    F.slice(v, 1, m).cast("array<double>"),
                    lambda acc, k: F.zip_with(acc, F.slice(v, k * m + 1, m), lambda a, b: a + _d(b))),
        lambda x: x / h)


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` names it, inner lambdas included."""
    return F.element_at(F.transform(F.array(value), fn), 1)
