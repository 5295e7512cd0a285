"""Rank statistics, moments and tests as relational operators.

Ranks are averages over ties. They come from counts per distinct value, so equal values are counted
before anything is sorted and no group has to fit in one task when ``group`` is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hot import HOT_BYTES
from .rangescan import cumulative_counts, plan_bytes


def corr(x, y) -> Column:
    """Pearson correlation; null where either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(spread > 0, spread)


def average_ranks(df: DataFrame, value: str, group: list[str] | None = None, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(group..., value, n, rank): each distinct value with its average rank among all rows of its group.

    Cumulative frequencies come from a window, or, for tables of more than ``hot_bytes`` whose groups may not
    fit in a task, from a range sort with partition offsets.
    """
    g = group or []
    c = df.filter(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count(F.lit(1)).alias("n"))
    if (size := plan_bytes(df)) is not None and size < hot_bytes:
        w = Window.partitionBy(*g).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        c = c.withColumn("cum", F.sum("n").over(w))
    else:
        c = cumulative_counts(c.withColumn("grp", F.coalesce(F.to_json(F.struct(*g)), F.lit("")) if g else F.lit("")), value).drop("grp")
    return c.withColumn("rank", F.col("cum") - (F.col("n") - 1) / 2.0).drop("cum")


def rank_sums(df: DataFrame, value: str, label: str, group: list[str] | None = None) -> DataFrame:
    """Per group and label: size and rank sum; with the group's size and tie term sum(t^3 - t)."""
    g = group or []
    r = average_ranks(df.select(*g, label, value), value, g)
    per = df.filter(F.col(value).isNotNull()).groupBy(*g, label, value).agg(F.count(F.lit(1)).alias("k"))
    on = [*g, value]
    sums = per.join(r.select(*g, value, "rank"), on).groupBy(*g, label).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("rs"))
    ties = r.groupBy(*g).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double").alias("ties"))
    return sums.join(ties, g) if g else sums.join(F.broadcast(ties))


def mann_whitney(df: DataFrame, value: str, label: str, first, second) -> DataFrame:
    """U of the first label, z with tie and continuity correction, and the rank-biserial 1 - 2U/(n1 n2)."""
    r = rank_sums(df.filter(F.col(label).isin(first, second)), value, label)
    a = r.filter(F.col(label) == first).select(F.col("n").alias("n1"), F.col("rs").alias("r1"), "total", "ties")
    b = r.filter(F.col(label) == second).select(F.col("n").alias("n2"))
    x = a.join(F.broadcast(b)).withColumn("u1", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    n = F.col("total").cast("double")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    d = F.col("u1") - F.col("n1") * F.col("n2") / 2.0
    z = F.when(sd > 0, F.signum(d) * F.greatest(F.abs(d) - 0.5, F.lit(0.0)) / sd)
    return x.select("n1", "n2", F.col("u1").alias("u"), z.alias("z"), (1 - 2 * F.col("u1") / (F.col("n1") * F.col("n2"))).alias("r"))


def kruskal(df: DataFrame, value: str, label: str, group: list[str] | None = None) -> DataFrame:
    """Tie-corrected H, number of labels k, size n and three forms of eta squared per group."""
    g = group or []
    r = rank_sums(df, value, label, g)
    k = r.groupBy(*g, "total", "ties").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("q"))
    n = F.col("total").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return k.withColumn("h", h).select(*g, "k", F.col("total").alias("n"), "h", (F.col("h") / (n - 1)).alias("eta2_h"), ((F.col("h") - F.col("k") + 1) / (n - F.col("k"))).alias("eta2_adj"))


def spearman(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """Correlation of average ranks per group."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y)
    rx = average_ranks(ok, x, group).select(*group, x, F.col("rank").alias("rx"))
    ry = average_ranks(ok, y, group).select(*group, y, F.col("rank").alias("ry"))
    return ok.join(rx, [*group, x]).join(ry, [*group, y]).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), corr("rx", "ry").alias("rho"))


def moments(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom; null where both variances are zero."""
    a, b = v1 / n1, v2 / n2
    t = F.when(a + b > 0, (m1 - m2) / F.sqrt(a + b))
    return t, F.when(a + b > 0, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)))


def anova(df: DataFrame, value: str, label: str) -> DataFrame:
    """One-way F with both degrees of freedom and SSB/SST."""
    g = df.filter(F.col(value).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = g.agg(F.sum("n").alias("nn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"))
    x = g.join(F.broadcast(total))
    s = x.agg(F.count(F.lit(1)).alias("k"), F.first("nn").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("mm")) * (F.col("m") - F.col("mm"))).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    return s.select((F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"), (F.col("ssb") / (F.col("k") - 1) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("f"), (F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta2"))


def benjamini_hochberg(df: DataFrame, p: str, *family: str) -> DataFrame:
    """Add q: false-discovery-adjusted p-values within a family; null p counts as 1."""
    w = Window.partitionBy(*family)
    pv = F.coalesce(F.col(p), F.lit(1.0))
    x = df.withColumn("_p", pv).withColumn("_m", F.count(F.lit(1)).over(w))
    # rank of the last of equal p-values, so ties share their q
    x = x.withColumn("_i", F.count(F.lit(1)).over(w.orderBy("_p").rangeBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_q", F.col("_p") * F.col("_m") / F.col("_i"))
    q = F.least(F.lit(1.0), F.min("_q").over(w.orderBy(F.desc("_p")).rangeBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("q", q).drop("_p", "_m", "_i", "_q")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "n.s.")
