"""Nearest-in-time join of two tables by entity (as-of join in both directions, with a tolerance).

Left and right records are range-partitioned together by (entity, time), so an entity may be larger
than one task. Every partition is scanned once; the last and first right record of its edge entities
are exchanged through a parallel prefix scan and complete the left records near partition edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rangescan import exclusive_scan, range_partitions, range_sorted
from ..scratch import materialize

_OUT = "pid int, ent string, kind int, id bigint, t bigint, bt bigint, bid bigint, ft bigint, fid bigint"
_SCHEMA = pa.schema([("pid", pa.int32()), ("ent", pa.string()), ("kind", pa.int32()), ("id", pa.int64()), ("t", pa.int64()), ("bt", pa.int64()), ("bid", pa.int64()), ("ft", pa.int64()), ("fid", pa.int64())])


def _scan(batches):
    """Local scan of one range partition: neighbours of each left record, then the edge records."""
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    table = pa.Table.from_batches(batches)
    names = table["ent"].combine_chunks()
    ent = names.dictionary_encode()
    ent = (ent.combine_chunks() if isinstance(ent, pa.ChunkedArray) else ent).indices.to_numpy()
    t, ids, side = (table[c].to_numpy() for c in ("t", "id", "side"))
    n = len(t)
    at = np.arange(n)
    right = side == 0
    # of right records with one time the smallest id stands for all of them
    same = np.zeros(n, bool)
    same[1:] = right[1:] & right[:-1] & (ent[1:] == ent[:-1]) & (t[1:] == t[:-1])
    first = np.maximum.accumulate(np.where(same, -1, at))
    before = np.maximum.accumulate(np.where(right, first, -1))
    after = np.minimum.accumulate(np.where(right, at, n)[::-1])[::-1]
    left = np.flatnonzero(~right)
    if len(left) > 1:  # rows delivered twice are neighbours here
        again = (ent[left][1:] == ent[left][:-1]) & (t[left][1:] == t[left][:-1]) & (ids[left][1:] == ids[left][:-1])
        left = left[np.concatenate(([True], ~again))]
    b, f = before[left], after[left]
    has_b = (b >= 0) & (ent[np.maximum(b, 0)] == ent[left])
    has_f = (f < n) & (ent[np.minimum(f, n - 1)] == ent[left])
    b, f = np.where(has_b, b, 0), np.where(has_f, f, 0)
    pid = table["pid"][0].as_py()

    def rows(index, kind, bt, bid, ft, fid):
        k = len(index)
        return pa.record_batch([pa.array(np.full(k, pid, np.int32)), names.take(pa.array(index)), pa.array(np.full(k, kind, np.int32)), pa.array(ids[index]), pa.array(t[index]), bt, bid, ft, fid], schema=_SCHEMA)

    yield rows(left, 1, pa.array(t[b], mask=~has_b), pa.array(ids[b], mask=~has_b), pa.array(t[f], mask=~has_f), pa.array(ids[f], mask=~has_f))
    edges = []
    for e in dict.fromkeys((ent[0], ent[-1])):
        own = np.flatnonzero(right & (ent == e))
        edges.append((e, own[0] if len(own) else None, first[own[-1]] if len(own) else None))
    index = np.array([np.flatnonzero(ent == e)[0] for e, _, _ in edges])
    pick = lambda col, j: pa.array([None if x[j] is None else int(col[x[j]]) for x in edges], pa.int64())
    # an edge row carries the partition's last right record in bt/bid and its first one in ft/fid
    yield rows(index, 0, pick(t, 2), pick(ids, 2), pick(t, 1), pick(ids, 1))


def nearest_time_join(left: DataFrame, right: DataFrame, tolerance_us: int, *, entity: str = "ent", time: str = "t", id: str = "id", partitions: int | None = None) -> DataFrame:
    """Pair each left record with the right record of its entity that is nearest in time.

    Both frames have ``entity`` (string), ``time`` (bigint microseconds) and ``id`` (bigint); other
    columns are ignored, so names may clash. Result: (left_id, right_id, delta_us), one row per
    distinct left record; right_id and delta_us are null where no right record lies within
    ``tolerance_us`` (inclusive). Of two equally near records the earlier wins, of two with one time
    the smaller id. Rows with a null entity or time never match: such left rows come out unmatched,
    such right rows are dropped. An empty side gives an empty or an all-unmatched result.
    """
    spark = left.sparkSession
    pick = lambda df, side: df.select(F.col(entity).cast("string").alias("ent"), F.col(time).cast("long").alias("t"), F.lit(side).alias("side"), F.col(id).cast("long").alias("id"))
    usable = lambda df: df.filter("ent is not null and t is not null")
    l, r = pick(left, 1), usable(pick(right, 0))
    both = usable(l).unionByName(r)
    n = partitions or range_partitions(spark, both)
    scanned = materialize(range_sorted(both, ["ent", "t", "side", "id"], n).mapInArrow(_scan, _OUT), "nearest")
    edge = scanned.filter("kind = 0").select("pid", "ent", F.when(F.col("bid").isNotNull(), F.struct("bt", "bid")).alias("lastr"), F.when(F.col("fid").isNotNull(), F.struct("ft", "fid")).alias("firstr"))
    # of equal times in different partitions the smaller id lies in the earlier one
    back = _first_of_tie(edge)
    ahead = exclusive_scan(edge, ["ent"], "firstr", "last", "nx", reverse=True)
    carry = back.join(ahead, ["pid", "ent"])
    # at most two carry rows per partition; the size is bounded by the number of partitions
    carry = F.broadcast(carry) if n <= 20_000 else carry
    # of equal times the record of the earlier partition has the smaller id
    bt = F.coalesce("bt", F.col("pv.bt"))
    bid = F.when(F.col("bt") > F.col("pv.bt"), F.col("bid")).otherwise(F.coalesce("pv.bid", "bid"))
    ft = F.coalesce("ft", F.col("nx.ft"))
    fid = F.coalesce("fid", F.col("nx.fid"))
    j = scanned.filter("kind = 1").join(carry, ["pid", "ent"], "left").select(F.col("id").alias("left_id"), "t", bt.alias("bt"), bid.alias("bid"), ft.alias("ft"), fid.alias("fid"))
    use_b = F.col("bt").isNotNull() & (F.col("ft").isNull() | (F.col("t") - F.col("bt") <= F.col("ft") - F.col("t")))
    near = j.select("left_id", F.when(use_b, F.col("bid")).otherwise(F.col("fid")).alias("right_id"), F.when(use_b, F.col("t") - F.col("bt")).otherwise(F.col("ft") - F.col("t")).alias("delta_us"))
    ok = F.col("delta_us") <= F.lit(int(tolerance_us))
    matched = near.select("left_id", F.when(ok, F.col("right_id")).alias("right_id"), F.when(ok, F.col("delta_us")).alias("delta_us"))
    unusable = l.filter("ent is null or t is null").select(F.col("id").alias("left_id"), F.lit(None).cast("long").alias("right_id"), F.lit(None).cast("long").alias("delta_us")).distinct()
    return matched.unionByName(unusable)


def _first_of_tie(edge: DataFrame) -> DataFrame:
    """Carry of the last right record before each partition; among equal times the smallest id."""
    key = F.when(F.col("lastr").isNotNull(), F.struct(F.col("lastr.bt").alias("bt"), (-F.col("lastr.bid")).alias("neg")))
    s = exclusive_scan(edge.select("pid", "ent", key.alias("k")), ["ent"], "k", "max", "m")
    return s.select("pid", "ent", F.when(F.col("m").isNotNull(), F.struct(F.col("m.bt").alias("bt"), (-F.col("m.neg")).alias("bid"))).alias("pv"))
