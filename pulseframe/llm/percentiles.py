"""Percentiles of very large numeric columns through cumulative frequencies.

Values are reduced to (group, value, n) counts; these are range-sorted by (group, value), every
partition adds up its own running sums and partition offsets complete them. A percentile is the
first value whose cumulative frequency reaches its target rank. Count tables of separate days or
files merge by adding counts, and the result equals that over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rangescan import cumulative_counts


def value_counts(df: DataFrame, group: str, value: str, resolution: float | None = None) -> DataFrame:
    """Mergeable summary (grp, v, n). Null and NaN values and null groups are skipped.

    With ``resolution`` values are rounded to its multiples: the table then holds at most
    range/resolution rows per group and every percentile is off by at most resolution/2. Without it
    percentiles are exact. Negative zero counts as zero.
    """
    v = F.col(value).cast("double")
    v = F.round(v / F.lit(resolution)) * F.lit(resolution) if resolution else v
    rows = df.select(F.col(group).cast("string").alias("grp"), (v + F.lit(0.0)).alias("v")).filter("grp is not null and v is not null and not isnan(v)")
    return rows.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Add up count tables of separate partitions, files or days."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("grp", "v").agg(F.sum("n").alias("n"))


def percentiles_from_counts(counts: DataFrame, qs: dict[str, float], partitions: int | None = None) -> DataFrame:
    """Percentiles per group from a count table (grp, v, n).

    ``qs`` maps output names to fractions in [0, 1]. Result: (grp, n_values, one column per
    percentile). Target ranks are those of linear interpolation: with h = (n-1)q the values at ranks
    floor(h)+1 and ceil(h)+1 are picked and joined in proportion. Groups without values are absent;
    an empty table gives no rows. A group may hold any share of the rows and span many tasks.
    """
    cum = cumulative_counts(counts.select("grp", "v", "n"), "v", partitions)
    size = cum.groupBy("grp").agg(F.max("cum").alias("n_values"))
    j = cum.join(size, "grp")
    picks, outs = [], []
    for name, q in qs.items():
        h = (F.col("n_values") - 1) * F.lit(float(q))
        for tag, rank in (("lo", F.floor(h) + 1), ("hi", F.ceil(h) + 1)):
            picks.append(F.min(F.when(F.col("cum") >= rank, F.col("v"))).alias(f"{name}_{tag}"))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        frac = (F.col("n_values") - 1) * F.lit(float(q))
        outs.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (frac - F.floor(frac))).alias(name))
    return j.groupBy("grp", "n_values").agg(*picks).select("grp", "n_values", *outs)


def group_percentiles(df: DataFrame, group: str, value: str, qs: dict[str, float], resolution: float | None = None) -> DataFrame:
    """``value_counts`` followed by ``percentiles_from_counts``."""
    return percentiles_from_counts(value_counts(df, group, value, resolution), qs)
