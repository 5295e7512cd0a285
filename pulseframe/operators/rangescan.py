"""Global range partitioning with an exclusive prefix scan over partition edges.

Many ordered operators (as-of joins, cumulative frequencies, interval unions, ranking) need a
per-key running value over a key that may be larger than one task. The pattern here:

1. range-partition by (key, order) and sort inside each partition, so one key spans neighbouring
   partitions only when it is large;
2. run the operator locally in every partition and emit one summary per partition edge key
   (only a partition's first and last key can continue elsewhere, so there are at most two
   summaries per partition, whatever the number of rows);
3. turn the summaries into carries with ``exclusive_scan`` (a two-level parallel prefix scan);
4. apply the carry to the local results with an ordinary join on (partition, key).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..scratch import materialize

PARTITION_BYTES = 64 << 20


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that a plan reads, as the optimizer knows them, without running it; None if it can't tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        if size >= 1 << 60:  # the optimizer's mark for unknown
            return None
        total += size
    return total


def range_partitions(spark: SparkSession, *frames: DataFrame, partition_bytes: int = PARTITION_BYTES) -> int:
    """Number of range partitions: the session's shuffle setting, or more if the data asks for it.

    Where the optimizer doesn't know a table's size its rows are counted, at a hundred bytes each.
    """
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [plan_bytes(f) for f in frames]
    known = sum(f.count() * 100 if s is None else s for f, s in zip(frames, sizes))
    return max(configured, known // partition_bytes)


def range_sorted(df: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """Range-partition and sort by ``keys``; column ``pid`` holds the partition number.

    Rows that agree in all keys always share a partition.
    """
    return df.repartitionByRange(partitions, *[F.col(k) for k in keys]).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id())


def exclusive_scan(edges: DataFrame, key: list[str], value: str, fn: str, out: str, reverse: bool = False, block: int = 256) -> DataFrame:
    """Exclusive prefix scan of ``value`` over ``pid`` for each key.

    ``edges`` has at most one row per (pid, key). ``fn`` is 'max', 'min', 'sum' or 'last' (the last
    non-null value in scan direction). Blocks of ``block`` partitions are scanned in parallel, the
    block totals are scanned once more and added, so no task sees more than ``block`` summaries or
    one total per block. Result: (pid, key..., out), null where nothing precedes.
    """
    e = edges.select("pid", *key, F.col(value).alias("_v")).withColumn("_b", F.floor(F.col("pid") / block))
    order = F.col("pid").desc() if reverse else F.col("pid").asc()
    block_order = F.col("_b").desc() if reverse else F.col("_b").asc()

    def over(c: Column, w) -> Column:
        return {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda x: F.last(x, ignorenulls=True)}[fn](c).over(w)

    inner = Window.partitionBy(*key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*key).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    total = {
        "max": F.max("_v"),
        "min": F.min("_v"),
        "sum": F.sum("_v"),
        "last": (F.min_by if reverse else F.max_by)("_v", F.when(F.col("_v").isNotNull(), F.col("pid"))),
    }[fn]
    totals = e.groupBy(*key, "_b").agg(total.alias("_t")).withColumn("_c", over(F.col("_t"), outer)).drop("_t")
    scanned = e.withColumn("_i", over(F.col("_v"), inner))
    on = [scanned[k].eqNullSafe(totals[k]) for k in key] + [scanned["_b"] == totals["_b"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = scanned.join(totals, cond, "left").select(scanned["pid"], *[scanned[k] for k in key], F.col("_i"), F.col("_c"))
    merged = {
        "max": F.greatest("_i", "_c"),
        "min": F.least("_i", "_c"),
        "sum": F.coalesce(F.col("_i") + F.col("_c"), F.col("_i"), F.col("_c")),
        "last": F.coalesce("_i", "_c"),
    }[fn]
    return joined.select("pid", *key, merged.alias(out))


def _number(order: list[str], distinct: bool):
    def run(batches):
        prev, rank, held = None, 0, None
        for b in batches:
            if distinct and b.num_rows:
                same = np.ones(b.num_rows, bool)
                for c in ["key", *order]:
                    x = b.column(c)
                    y = pa.concat_arrays([pa.array([held[c] if held else None], x.type), x.slice(0, len(x) - 1)])
                    e = pc.fill_null(pc.equal(x, y), False)
                    same &= pc.or_(e, pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
                same[0] &= held is not None
                held = {c: b.column(c)[-1].as_py() for c in ["key", *order]}
                b = b.filter(pa.array(~same))
            n = b.num_rows
            if not n:
                continue
            key = b.column("key").to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.concatenate(([prev is None or key[0] != prev], key[1:] != key[:-1])))
            at = np.arange(n)
            mark = np.full(n, -1)
            mark[start] = start
            mark = np.maximum.accumulate(mark)
            numbers = np.where(mark < 0, at + rank, at - mark)
            prev, rank = key[-1], int(numbers[-1]) + 1
            yield pa.record_batch([*b.columns, pa.array(numbers, pa.int64())], [*b.schema.names, "rank"])

    return run


def number_rows(df: DataFrame, key: str, order: list[str], partitions: int | None = None, distinct: bool = False) -> DataFrame:
    """0-based number of every row within its bigint ``key``, in the order of ``order``.

    The key may hold any share of the rows: rows are numbered inside range partitions and shifted by
    what earlier partitions hold of their key. Columns of ``df`` are kept, ``rank`` is added. With ``distinct``
    rows that agree in key and order count once.
    """
    n = partitions or range_partitions(df.sparkSession, df)
    cols = df.columns
    sorted_ = range_sorted(df.withColumn("key", F.col(key).cast("long")), ["key", *order], n)
    schema = StructType([*sorted_.schema.fields, StructField("rank", LongType())])
    local = materialize(sorted_.mapInArrow(_number(list(order), distinct), schema), "numbered")
    # only a partition's first and last key continue elsewhere
    sums = local.groupBy("pid", "key").agg((F.max("rank") + 1).alias("c"))
    ends = local.groupBy("pid").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    edges = sums.join(ends, "pid").filter("key = lo or key = hi").select("pid", "key", "c")
    off = exclusive_scan(edges, ["key"], "c", "sum", "off").filter("off is not null")
    return local.join(off, ["pid", "key"], "left").withColumn("rank", F.col("rank") + F.coalesce("off", F.lit(0))).select(*cols, "rank")


def _running(batches):
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    code = t["grp"].combine_chunks().dictionary_encode()
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
    n = t["n"].to_numpy()
    start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    total = np.cumsum(n)
    base = np.repeat(np.where(start > 0, total[start - 1], 0), np.diff(np.append(start, len(code))))
    last = np.zeros(len(code), bool)
    last[np.append(start[1:], len(code)) - 1] = True
    edge = ((code == code[0]) | (code == code[-1])) & last
    yield from t.append_column("run", pa.array(total - base)).append_column("edge", pa.array(edge)).to_batches()


def cumulative_counts(counts: DataFrame, value: str, partitions: int | None = None) -> DataFrame:
    """Add ``cum``: the cumulative frequency of each row of (grp string, value, n bigint, ...) within its group.

    Groups must not be null and may span many tasks: partitions add up their own running sums, and what
    earlier partitions hold of an edge group is added by a prefix scan.
    """
    parts = partitions or range_partitions(counts.sparkSession, counts)
    cols = counts.columns
    sorted_ = range_sorted(counts, ["grp", value], parts)
    schema = StructType([*sorted_.schema.fields, StructField("run", LongType()), StructField("edge", BooleanType())])
    run = materialize(sorted_.mapInArrow(_running, schema), "cumulative")
    # an edge row's running sum is what its partition adds to the group
    carry = exclusive_scan(run.filter("edge"), ["grp"], "run", "sum", "off")
    carry = F.broadcast(carry) if parts <= 20_000 else carry
    return run.join(carry, ["pid", "grp"], "left").withColumn("cum", F.col("run") + F.coalesce("off", F.lit(0))).select(*cols, "cum")
