"""Row windows over keys of any size.

A window function sorts all rows of a key in one task. ``row_windows`` does the same for frames of a
fixed number of rows, but cuts keys with more than ``HOT_ROWS`` rows into blocks of neighbouring rows
that overlap by the frame, so a key with a third of all rows spreads over many tasks. Tables that are
too small to hold such a key skip the count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..scratch import materialize
from .rangescan import PARTITION_BYTES, exclusive_scan, number_rows, plan_bytes, range_partitions, range_sorted

#: Rows of a key from which it is split; a table of no more bytes than one task reads holds no such key, others and tables of unknown size are counted.
HOT_ROWS, HOT_BYTES = 5_000_000, PARTITION_BYTES


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> list:
    """Keys with more rows than that; their number is at most the table's rows / hot_rows."""
    return [r[0] for r in df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(key).collect()]


def row_windows(df: DataFrame, key: str, order: list[str], before: int, after: int, columns: dict[str, Callable[[WindowSpec], Column]], hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Add ``columns``, each a function of a window over ``key`` in ``order``.

    They may look at most ``before`` rows back and ``after`` rows ahead (lag, lead, rowsBetween). The
    order must be total within a key, else ties are as arbitrary as in any window. Null keys are one key.
    """
    plain = lambda d, w: d.withColumns({n: f(w) for n, f in columns.items()})
    whole = Window.partitionBy(key).orderBy(*order)
    if (size := plan_bytes(df)) is not None and size < hot_bytes:
        return plain(df, whole)
    hot = hot_keys(df, key, hot_rows)
    if not hot:
        return plain(df, whole)
    known = [k for k in hot if k is not None]
    is_hot = F.coalesce(F.col(key).isin(known), F.lit(None in hot)) if known else F.col(key).isNull()
    cold = plain(df.filter(~is_hot), whole)
    index = F.lit(-1)
    for i, k in enumerate(hot):
        index = F.when(F.col(key).isNull() if k is None else F.col(key) == F.lit(k), i).otherwise(index)
    ranked = number_rows(df.filter(is_hot).withColumn("_k", index), "_k", order)
    block, reach = max(hot_rows, 4 * (before + after + 1)), F.col("rank")
    at = lambda c: F.floor(c / block)
    # a row is seen by every block whose frames reach it
    seen = F.array_distinct(F.array(at(reach), at(reach - after), at(reach + before)))
    cut = ranked.withColumn("_home", at(reach)).withColumn("_b", F.explode(seen))
    w = Window.partitionBy("_k", "_b").orderBy("rank")
    done = plain(cut, w).filter(F.col("_b") == F.col("_home"))
    return cold.unionByName(done.select(*cold.columns))


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, fn: str, name: str, exclusive: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Add ``name``: the running 'max', 'sum' or 'last' (last non-null) of ``value`` over ``keys`` in ``order``.

    Tables of more than ``hot_bytes``, or of unknown size, are range-sorted: every partition adds up its own rows, and a
    prefix scan carries what earlier partitions hold of a key, so a key may hold any share of the rows.
    ``exclusive`` leaves the row itself out. Null keys are one key; ties in ``order`` are as arbitrary as in any window.
    """
    agg = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[fn]
    last = -1 if exclusive else 0
    if (size := plan_bytes(df)) is not None and size < hot_bytes:
        return df.withColumn(name, agg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)))
    cols = df.columns
    d = materialize(range_sorted(df.withColumn("_v", value), [*keys, *order], range_partitions(df.sparkSession, df)), "running")
    d = d.withColumn("_l", agg("_v").over(Window.partitionBy("pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)))
    total = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))) if fn == "last" else agg("_v")
    carry = exclusive_scan(d.groupBy("pid", *keys).agg(total.alias("_t")), keys, "_t", fn, "_c").filter("_c is not null")
    carry = carry.select(F.col("pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_c")
    on = d["pid"] == carry["_p"]
    for i, k in enumerate(keys):
        on = on & d[k].eqNullSafe(carry[f"_k{i}"])
    merged = {"max": F.greatest("_l", "_c"), "sum": F.coalesce(F.col("_l") + F.col("_c"), F.col("_l"), F.col("_c")), "last": F.coalesce("_l", "_c")}[fn]
    return d.join(carry, on, "left").select(*cols, merged.alias(name))
