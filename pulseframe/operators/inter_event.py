"""Operators between the events of one entity: intervals, counts, transitions, rates.

All take column names for entity, order (bigint, usually microseconds) and tie-breaker; missing
neighbours give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(entity: str | list[str], *order: str) -> WindowSpec:
    keys = [entity] if isinstance(entity, str) else entity
    return Window.partitionBy(*keys).orderBy(*order)


def isi_next(us: str, w: WindowSpec) -> Column:
    """Milliseconds to the next event; null for the last."""
    return (F.lead(us).over(w) - F.col(us)) / 1000.0


def isi_prev(us: str, w: WindowSpec) -> Column:
    """Milliseconds since the event before; null for the first."""
    return (F.col(us) - F.lag(us).over(w)) / 1000.0


def count_preceding(us: str, entity: str, window_us: int) -> Column:
    """Other events of the entity in the half-open window (t - window, t]; events at the same time count."""
    w = Window.partitionBy(entity).orderBy(us).rangeBetween(-(window_us - 1), 0)
    return F.count(F.lit(1)).over(w) - 1


def log10_positive(c: Column) -> Column:
    """log10 of positive values, null otherwise."""
    return F.when(c > 0, F.log10(c))


def transition_counts(pairs: DataFrame) -> DataFrame:
    """(from_label, to_label, n, p) of pairs of successive labels; a label never left has no row."""
    n = pairs.filter("from_label is not null and to_label is not null").groupBy("from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_label")))


def transitions(df: DataFrame, entity: str, label: str, *order: str) -> DataFrame:
    """Counts of successive labels of an entity, normalised over each label that is left."""
    return transition_counts(df.select(F.col(label).alias("from_label"), F.lead(label).over(ordered(entity, *order)).alias("to_label")))


def equal_bins(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based equal-width bin, the last one closed on the right; null where the range is empty."""
    return F.when(hi > lo, F.least(F.floor((x - lo) / ((hi - lo) / n)), F.lit(n - 1))).cast("long")


def min_max_normalised(x: str, entity: str) -> Column:
    w = Window.partitionBy(entity)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi > lo, (F.col(x) - lo) / (hi - lo))
