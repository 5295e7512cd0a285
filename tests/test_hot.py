import random

import pytest
from pyspark.sql import functions as F

from pulseframe.operators.hot import row_windows

COLUMNS = {
    "prev": lambda w: F.lag("v", 2).over(w),
    "nxt": lambda w: F.lead("v").over(w),
    "mean": lambda w: F.round(F.avg("v").over(w.rowsBetween(-5, 3)), 9),
    "n": lambda w: F.count("v").over(w.rowsBetween(-5, 3)),
}


@pytest.mark.parametrize("hot_rows", [3, 40, 10_000])
def test_blocks_give_what_whole_windows_give(spark, hot_rows):
    rng = random.Random(hot_rows)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(("a", "b", None)), i, rng.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    want = sorted(row_windows(df, "k", ["t"], 5, 3, COLUMNS, hot_bytes=1 << 62).collect(), key=lambda r: r.t)
    got = sorted(row_windows(df, "k", ["t"], 5, 3, COLUMNS, hot_rows=hot_rows, hot_bytes=0).collect(), key=lambda r: r.t)
    assert got == want


def test_empty(spark):
    assert row_windows(spark.createDataFrame([], "k string, t long, v double"), "k", ["t"], 5, 3, COLUMNS, hot_rows=1, hot_bytes=0).count() == 0


def test_running_values_of_a_key_with_most_rows(spark):
    """Range partitions with carries give what a window over the whole key gives, for each function and null keys."""
    import random

    from pulseframe.operators.hot import running
    from pulseframe.operators.ranges import asof_last, islands, runs

    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(("a", None)), i, rng.choice((None, *range(50))), i * 3 + rng.randrange(3)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, v long, t long")
    big = 1 << 62
    for fn in ("max", "sum", "last"):
        for exclusive in (False, True):
            plain = spark.createDataFrame(rows, df.schema).coalesce(1)
            from pyspark.sql import Window
            from pyspark.sql import functions as F

            agg = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[fn]
            want = plain.withColumn("x", agg("v").over(Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)))
            got = running(df, ["k"], ["i"], F.col("v"), fn, "x", exclusive, hot_bytes=0)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    whole = lambda f: [sorted(map(tuple, f(b).collect()), key=str) for b in (0, big)]
    for f in (
        lambda b: islands(df.withColumn("e", F.col("t") + 4), "k", "t", "e", 1, hot_bytes=b),
        lambda b: runs(df, "k", F.col("v") > 20, "i", hot_bytes=b),
        lambda b: asof_last(df.select("k", "i", "t"), df.filter("i % 7 = 0"), "k", "t", "i", F.col("v"), "x", hot_bytes=b),
    ):
        cut, one = whole(f)
        assert cut == one and cut
