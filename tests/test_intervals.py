import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseframe.operators.intervals import IntervalMap, merge_intervals, micros


def brute(rows):
    out = []
    for k in sorted({r[0] for r in rows if r[0] is not None}):
        own = sorted({(s, e) for a, s, e in rows if a == k and s is not None and e is not None and e > s})
        merged = []
        for s, e in own:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20))))
def test_map_against_brute_force(parts):
    m = IntervalMap()
    for s, n in parts:
        m.insert(s, s + n)
    want = brute([("k", s, s + n) for s, n in parts])
    assert sorted([("k", "period", *p) for p in m.periods()] + [("k", "gap", *g) for g in m.gaps()]) == want


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_merge_with_a_key_larger_than_a_partition(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for i in range(900):
        k = "hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}"
        s = rng.randrange(0, 40_000)
        rows.append((k, s, s + rng.choice((1, 5, 40, 9000 if i % 200 == 0 else 3))))
    rows += [rows[0], (None, 1, 2), ("hot", None, 3), ("hot", 3, None), ("hot", 9, 9), ("hot", 9, 2)]
    df = spark.createDataFrame(rows, "key string, s long, e long").withColumn("edge", F.lit(7))
    got = sorted(tuple(r) for r in merge_intervals(df, "key", "s", "e", partitions=partitions).collect())
    assert got == brute(rows)


def test_merge_empty(spark):
    assert merge_intervals(spark.createDataFrame([], "key string, s long, e long"), "key", "s", "e", partitions=2).count() == 0


def test_micros(spark):
    df = spark.createDataFrame([(1.5, "ms"), (1.5, "s"), (float("nan"), "s"), (None, "s"), (float("inf"), "ms"), (1.0, "min"), (1.0, None)], "v double, u string")
    assert [r[0] for r in df.select(micros(F.col("v"), F.col("u"))).collect()] == [1500, 1_500_000, None, None, None, None, None]
