"""Union of overlapping intervals per entity, with the gaps between the merged periods.

``IntervalMap`` is the keyed state: an ordered map of disjoint intervals into which pieces are inserted as they
arrive, in any order; every insertion finds the overlapped ones by binary search, merges them and thereby
updates the gaps. The streaming operator keeps one per entity between batches. The batch operator keeps one
per entity and range of starts, and carries the furthest end across the ranges with a prefix scan, so one
entity may hold any share of the rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .rangescan import exclusive_scan, range_partitions


class IntervalMap:
    """Disjoint closed intervals in order; intervals that touch count as one.

    They lie in blocks of at most ``BLOCK``, so an insertion moves a block's rest, never the whole map's.
    """

    BLOCK = 512
    __slots__ = ("blocks", "ahead")

    def __init__(self, starts=(), ends=()):
        starts, ends = list(starts), list(ends)
        self.blocks = [(starts[k : k + self.BLOCK], ends[k : k + self.BLOCK]) for k in range(0, len(starts), self.BLOCK)]
        #: The last end of every block.
        self.ahead = [e[-1] for _, e in self.blocks]

    def insert(self, start: int, end: int) -> None:
        first = bisect_left(self.ahead, start)  # first block with an interval that ends at or after the start
        if first == len(self.blocks):
            if not first or len(self.blocks[-1][0]) >= self.BLOCK:
                self.blocks.append(([], []))
                self.ahead.append(end)
            self.blocks[-1][0].append(start)
            self.blocks[-1][1].append(end)
            self.ahead[-1] = end
            return
        last = first
        while last + 1 < len(self.blocks) and self.blocks[last + 1][0][0] <= end:
            last += 1
        if last > first:  # what is overlapped lies in several blocks
            starts, ends = [x for s, _ in self.blocks[first : last + 1] for x in s], [x for _, e in self.blocks[first : last + 1] for x in e]
        else:
            starts, ends = self.blocks[first]
        lo = bisect_left(ends, start)  # first interval that ends at or after the start
        hi = bisect_right(starts, end)  # first interval that starts after the end
        if lo < hi:
            start, end = min(start, starts[lo]), max(end, ends[hi - 1])
        starts[lo:hi] = [start]
        ends[lo:hi] = [end]
        half = len(starts) // 2
        parts = [(starts, ends)] if len(starts) <= self.BLOCK else [(starts[:half], ends[:half]), (starts[half:], ends[half:])]
        self.blocks[first : last + 1] = parts
        self.ahead[first : last + 1] = [e[-1] for _, e in parts]

    @property
    def starts(self) -> list[int]:
        return [x for s, _ in self.blocks for x in s]

    @property
    def ends(self) -> list[int]:
        return [x for _, e in self.blocks for x in e]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))


def micros(value: Column, unit: Column) -> Column:
    """Whole microseconds of a double in 'ms', 's' or 'us'; null for other units, null, NaN, infinity."""
    scale = F.when(unit == "ms", 1e3).when(unit == "s", 1e6).when(unit == "us", 1.0)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 9e12)
    return F.when(finite, F.round(value * scale).cast("long"))


def _local(batches):
    key, held, pid, first = None, None, None, True

    def rows(edge):
        starts, ends = held.starts, held.ends
        return pd.DataFrame({"pid": pid, "key": key, "s": starts, "e": ends, "pe": pd.array([None, *ends[:-1]], dtype="Int64"), "edge": [edge] * len(starts)})

    for pdf in batches:
        if not len(pdf):
            continue
        pid = int(pdf["pid"].iat[0])
        for k, part in pdf.groupby("key", sort=False):
            if k != key:
                if key is not None:
                    yield rows(first)
                    first = False
                key, held = k, IntervalMap()
            for s, e in zip(part["s"].tolist(), part["e"].tolist()):
                held.insert(s, e)
    if key is not None:
        yield rows(True)


def merge_intervals(df: DataFrame, key: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """Periods and gaps per key.

    ``df`` has ``key`` (string), ``start`` and ``end`` (bigint). Rows with a null key, a missing
    bound or an end not after its start count for nothing. Result: (key, seg_kind, start, end) with
    seg_kind 'period' (a longest stretch covered by intervals that overlap, nest or touch) or 'gap'
    (between two successive periods). Repeated rows change nothing; an empty table gives no rows.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).filter("key is not null and e > s")
    n = partitions or range_partitions(df.sparkSession, rows)
    # ranges of (key, start); within a range the pieces of a key come as they arrived
    dealt = rows.repartitionByRange(n, "key", "s").sortWithinPartitions("key").withColumn("pid", F.spark_partition_id())
    local = materialize(dealt.mapInPandas(_local, "pid int, key string, s long, e long, pe long, edge boolean"), "intervals")
    edges = local.filter("edge").groupBy("pid", "key").agg(F.max("e").alias("e"))
    reach = exclusive_scan(edges, ["key"], "e", "max", "reach")
    reached = local.join(F.broadcast(reach) if n <= 20_000 else reach, ["pid", "key"], "left").withColumn("opens", F.col("reach").isNull() | (F.col("s") > F.col("reach")))
    # a period that an earlier partition's period reaches into belongs to the last one opened before it
    opened = reached.filter("edge").groupBy("pid", "key").agg(F.max(F.when(F.col("opens"), F.col("s"))).alias("o"))
    before = exclusive_scan(opened, ["key"], "o", "max", "home")
    whole = reached.join(F.broadcast(before) if n <= 20_000 else before, ["pid", "key"], "left")
    periods = whole.groupBy("key", F.when(F.col("opens"), F.col("s")).otherwise(F.col("home")).alias("start")).agg(F.max("e").alias("end")).select("key", F.lit("period").alias("seg_kind"), "start", "end")
    ahead = F.greatest("reach", "pe")
    gaps = reached.filter(F.col("opens") & ahead.isNotNull()).select("key", F.lit("gap").alias("seg_kind"), ahead.alias("start"), F.col("s").alias("end"))
    return periods.unionByName(gaps)
