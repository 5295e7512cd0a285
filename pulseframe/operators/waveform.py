"""Array expressions over the waveform of one event (array<double>), all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(a: Column) -> Column:
    """Mean of an array without nulls; null for an empty one."""
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def std_pop(a: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(mean(F.transform(a, lambda x: (x - mean(a)) * (x - mean(a)))))


def zscore(a: Column) -> Column:
    """Standardised array; a constant one becomes zeros."""
    return F.transform(a, lambda x: (x - mean(a)) / F.when(std_pop(a) == 0, F.lit(1.0)).otherwise(std_pop(a)))


def argmax(a: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def absolute(a: Column) -> Column:
    return F.transform(a, lambda x: F.abs(x))


def half_width(a: Column) -> Column:
    """Samples of at least half the largest magnitude."""
    return F.size(F.filter(absolute(a), lambda x: x >= 0.5 * F.array_max(absolute(a)))).cast("long")


def window(a: Column, centre: Column, before: int, after: int) -> Column:
    """The slice from ``before`` samples before the 0-based centre to ``after`` behind it; null unless it lies inside."""
    return F.when((centre >= before) & (centre + after < F.size(a)), F.slice(a, (centre - before + 1).cast("int"), before + after + 1))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mae(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def nrmse(a: Column, b: Column) -> Column:
    """Root mean squared error over the larger magnitude of both; null if both are zero."""
    top = F.greatest(F.array_max(absolute(a)), F.array_max(absolute(b)))
    return F.when(top > 0, rmse(a, b) / top)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def first_at_most(a: Column, level: Column) -> Column:
    """0-based place of the first sample at or below a level; null if none."""
    at = F.array_position(F.transform(a, lambda x: (x <= level).cast("int")), F.lit(1))
    return F.when(at > 0, (at - 1).cast("long"))


def trapezoid(a: Column, step: Column) -> Column:
    """Trapezoid area under equally spaced samples."""
    return step * (F.aggregate(a, F.lit(0.0), lambda s, x: s + x) - (F.element_at(a, 1) + F.element_at(a, -1)) / 2)


def decimate(a: Column, k: int) -> Column:
    """Every k-th sample from the first on."""
    return F.filter(a, lambda x, i: i % k == 0)


def convolve_same(a: Column, kernel: list[float]) -> Column:
    """Convolution of the same length, zero-padded at both ends."""
    h = len(kernel) // 2
    n = F.size(a)
    taps = [(k - h, w) for k, w in enumerate(kernel)]

    def at(i):
        out = F.lit(0.0)
        for k, w in taps:
            j = i - k
            out = out + F.when((j >= 0) & (j < n), F.get(a, j.cast("int"))).otherwise(0.0) * w
        return out

    return F.transform(a, lambda x, i: at(i))
