"""Irregular readings onto a regular grid, by an as-of merge of sorted grid and readings.

Every slot of a source takes its neighbouring readings on both sides. Numeric series are
interpolated linearly in time between them, label series take the nearer one; slots further from a
reading than the gap limit stay marked as missing. Readings are reduced to at most four per slot
before the shuffle, and a source is cut into blocks of slots with a halo as wide as the gap limit,
so a source may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def regular_grid(readings: DataFrame, spans: DataFrame, slot_ms: float, gap_slots: int = 5, kind: str = "number") -> DataFrame:
    """Regular series per source.

    ``readings``: (source string, t double ms, v); ``spans``: (source string, duration_ms double), one
    row per source (repeats are allowed; the largest duration counts). Slot k covers
    [k*slot_ms, (k+1)*slot_ms) and is valued at its middle. Readings before 0, at or after the
    duration, or with a null or NaN time or value (or a null source) count for nothing; repeated
    readings change nothing. Result: (source, slot_no, status, value) with status 'observed' (the slot
    holds a reading), 'filled' (a neighbour on both sides for numbers, on one side for labels, within
    ``gap_slots``) or 'missing' (value null). Sources without a positive finite duration give no rows.
    """
    number = kind == "number"
    span = spans.select(F.col("source").cast("string").alias("source"), F.col("duration_ms").cast("double").alias("d")).filter("source is not null and d > 0 and not isnan(d) and d < 1e15")
    span = span.groupBy("source").agg(F.max("d").alias("d"))
    v = F.col("v").cast("double" if number else "string")
    r = readings.select(F.col("source").cast("string").alias("source"), F.col("t").cast("double").alias("t"), v.alias("v"))
    r = r.filter("t >= 0 and not isnan(t) and v is not null" + (" and not isnan(v)" if number else ""))
    r = r.withColumn("slot", F.floor(F.col("t") / slot_ms))
    mid = (F.col("slot") + 0.5) * slot_ms
    # at most four readings stand for a slot: the outermost, and those around its middle
    tv = F.struct("t", "v")
    held = r.join(span, "source").filter("t < d").groupBy("source", "slot").agg(
        F.min(tv).alias("lo"), F.max(tv).alias("hi"), F.max(F.when(F.col("t") <= mid, tv)).alias("b"), F.min(F.when(F.col("t") >= mid, tv)).alias("f")
    )
    wide = max(BLOCK, gap_slots + 1)  # a halo never skips a block
    block = lambda s: F.floor(s / wide)
    slot = F.col("slot")
    # the halo: a slot's readings are also seen by a neighbouring block within the gap limit
    seen = F.array_distinct(F.array(block(slot - gap_slots), block(slot), block(slot + gap_slots)))
    held = held.withColumn("blk", F.explode(seen)).withColumn("own", F.lit(False))
    grid = span.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("d") / slot_ms).cast("long") - 1)).alias("slot")).withColumn("blk", block(slot)).withColumn("own", F.lit(True))
    empty = F.lit(None).cast(f"struct<t:double,v:{'double' if number else 'string'}>")
    grid = grid.select("source", "slot", *[empty.alias(c) for c in ("lo", "hi", "b", "f")], "blk", "own")
    both = grid.unionByName(held)
    w = Window.partitionBy("source", "blk")
    up = w.orderBy(F.col("slot").asc(), F.col("own").asc())
    down = w.orderBy(F.col("slot").desc(), F.col("own").asc())
    prev = F.last("hi", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.last("lo", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    here = F.lag(F.struct("slot", "lo", "b", "f"), 1).over(up)
    pslot = F.last(F.when(F.col("hi").isNotNull(), slot), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    nslot = F.last(F.when(F.col("lo").isNotNull(), slot), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    m = both.withColumns({"here": here, "p": prev, "ps": pslot}).withColumns({"n": nxt, "ns": nslot}).filter("own")
    seen_here = (F.col("here.slot") == slot) & F.col("here.lo").isNotNull()
    # inside a held slot the reading before (after) its middle may lie in the slot before (after)
    back = F.when(seen_here & F.col("here.b").isNotNull(), F.col("here.b")).when(~F.coalesce(seen_here, F.lit(False)) & (slot - F.col("ps") <= gap_slots), F.col("p"))
    ahead = F.when(seen_here & F.col("here.f").isNotNull(), F.col("here.f")).when(~F.coalesce(seen_here, F.lit(False)) & (F.col("ns") - slot <= gap_slots), F.col("n"))
    m = m.select("source", "slot", F.coalesce(seen_here, F.lit(False)).alias("obs"), back.alias("a"), ahead.alias("z"), mid.alias("g"))
    closer = F.when(F.col("z").isNull() | (F.col("g") - F.col("a.t") <= F.col("z.t") - F.col("g")), F.col("a.v")).otherwise(F.col("z.v"))
    if number:
        share = (F.col("g") - F.col("a.t")) / (F.col("z.t") - F.col("a.t"))
        linear = F.when(F.col("z.t") > F.col("a.t"), F.col("a.v") + (F.col("z.v") - F.col("a.v")) * share).when(F.col("a").isNotNull() & F.col("z").isNotNull(), F.col("a.v"))
        value = F.when(F.col("obs"), F.coalesce(linear, closer)).otherwise(linear)
    else:
        value = closer
    status = F.when(F.col("obs"), "observed").when(value.isNotNull(), "filled").otherwise("missing")
    return m.select("source", F.col("slot").alias("slot_no"), status.alias("status"), value.alias("value"))
