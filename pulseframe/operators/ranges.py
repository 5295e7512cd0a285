"""Interval operators: islands, range joins by bucket, as-of joins by window, intersections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hot import HOT_BYTES, running


def islands(df: DataFrame, entity: str, start: str, end: str, gap: int, least: int = 0, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Blocks of intervals that lie at most ``gap`` apart, at least ``least`` long: (entity, block, start, end, n)."""
    d = df.select(entity, F.col(start).alias("_s"), F.col(end).alias("_e"))
    reached = running(d, [entity], ["_s", "_e"], F.col("_e"), "max", "_reach", exclusive=True, hot_bytes=hot_bytes)
    new = F.when(F.col("_reach").isNull() | (F.col("_s") - F.col("_reach") > gap), 1).otherwise(0)
    run = running(reached.withColumn("_new", new).drop("_reach"), [entity], ["_s", "_e"], F.col("_new"), "sum", "block", hot_bytes=hot_bytes)
    out = run.groupBy(entity, "block").agg(F.min("_s").alias("start"), F.max("_e").alias("end"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("end") - F.col("start") >= least)


def range_join(points: DataFrame, blocks: DataFrame, entity: str, at: str, start: str, end: str, bucket: int, how: str = "inner") -> DataFrame:
    """Join points with the half-open intervals [start, end) of their entity that hold them.

    Every interval is listed in each bucket of width ``bucket`` it touches, so the join is an equality on
    (entity, bucket) and stays a hash or sort-merge join; choose a bucket about as wide as an interval.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    spread = F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))
    b = blocks.filter(F.col(end) > F.col(start)).withColumn("_b", F.explode(spread)).withColumnRenamed(entity, "_ent")
    cond = (p[entity] == b["_ent"]) & (p["_b"] == b["_b"]) & (p[at] >= b[start]) & (p[at] < b[end])
    return p.join(b, cond, how).drop(b["_b"]).drop("_b", "_ent")


def asof_last(left: DataFrame, right: DataFrame, entity: str, at: str, tie: str, value: Column, name: str, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Add to each left row the value of the last right row of its entity at or before it.

    A union sorted by time with one running value: no join. Right rows at the same time count, the one with the
    largest ``tie`` wins.
    """
    cols = left.columns
    l = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(value.alias("v")).schema[0].dataType))
    r = right.select(*[F.col(c) if c in (entity, at, tie) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.lit(0).alias("_side"), value.alias("_v"))
    both = running(l.unionByName(r), [entity], [at, "_side", tie], F.col("_v"), "last", name, hot_bytes=hot_bytes)
    return both.filter("_side = 1").select(*cols, name)


def intersections(a: DataFrame, b: DataFrame, entity: str, bucket: int) -> DataFrame:
    """Parts that intervals (entity, start, end) of both sides have in common."""
    spread = F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))
    l = a.select(entity, F.col("start").alias("s1"), F.col("end").alias("e1"), F.explode(spread).alias("_b"))
    r = b.select(entity, F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(spread).alias("_b"))
    lo, hi = F.greatest("s1", "s2"), F.least("e1", "e2")
    j = l.join(r, [entity, "_b"]).filter(lo < hi).filter(F.floor(lo / bucket) == F.col("_b"))
    return j.select(entity, lo.alias("start"), hi.alias("end"))


def runs(df: DataFrame, entity: str, mask: Column, *order: str, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Numbers the stretches of equal mask within an entity, by the difference of two row numbers."""
    m = df.withColumn("mask", mask)
    a = running(m, [entity], list(order), F.lit(1), "sum", "_a", hot_bytes=hot_bytes)
    b = running(a, [entity, "mask"], list(order), F.lit(1), "sum", "_b", hot_bytes=hot_bytes)
    return b.withColumn("run", F.col("_a") - F.col("_b")).drop("_a", "_b")
