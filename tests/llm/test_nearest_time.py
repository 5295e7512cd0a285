import random

import pytest
from pyspark.sql import functions as F

from pulseframe.llm.nearest_time import nearest_time_join

SCHEMA = "ent string, t long, id long"


def brute(left, right, tol):
    out = {}
    for e, t, i in set(left):
        best = min(((abs(u - t), u, j) for a, u, j in right if a == e and e is not None and u is not None and t is not None), default=None)
        out[i] = (best[2], best[0]) if best and best[0] <= tol else (None, None)
    return out


@pytest.mark.parametrize("partitions", [1, 4, 11])
def test_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    ent = lambda: "hot" if rng.random() < 0.5 else f"e{rng.randrange(8)}"
    left = [(ent(), rng.randrange(4000), i) for i in range(400)]
    right = [(ent(), rng.randrange(4000) // 7 * 7, 1000 + i) for i in range(300)]
    left += [left[0], left[0], (None, 5, 900), ("hot", None, 901), ("lonely", 5, 902)]
    right += [right[0], (None, 5, 2000), ("hot", None, 2001)]
    l = spark.createDataFrame(left, SCHEMA).withColumn("bid", F.lit("clash"))
    got = nearest_time_join(l, spark.createDataFrame(right, SCHEMA), 20, partitions=partitions).collect()
    assert {r.left_id: (r.right_id, r.delta_us) for r in got} == brute(left, right, 20)
    assert len(got) == len(set(left))


def test_ties_take_the_earlier_and_the_smaller(spark):
    l = spark.createDataFrame([("a", 10, 1), ("a", 30, 2)], SCHEMA)
    r = spark.createDataFrame([("a", 5, 9), ("a", 5, 8), ("a", 15, 7), ("a", 30, 6), ("a", 30, 5)], SCHEMA)
    got = {x.left_id: (x.right_id, x.delta_us) for x in nearest_time_join(l, r, 5, partitions=3).collect()}
    assert got == {1: (8, 5), 2: (5, 0)}


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", 1, 1)], SCHEMA)
    assert nearest_time_join(none, some, 5, partitions=2).count() == 0
    assert [tuple(r) for r in nearest_time_join(some, none, 5, partitions=2).collect()] == [(1, None, None)]
