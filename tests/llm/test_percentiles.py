import random

import numpy as np
import pytest

from pulseframe.llm.percentiles import group_percentiles, merge_counts, percentiles_from_counts, value_counts

QS = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_numpy(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", round(rng.gauss(0, 1), 2)) for _ in range(2500)]
    rows += [("one", 4.0), ("hot", None), ("hot", float("nan")), (None, 1.0), ("none", None), ("hot", -0.0)]
    df = spark.createDataFrame(rows, "grp string, v double").selectExpr("*", "1 as n", "2 as pid")
    got = {r.grp: r for r in percentiles_from_counts(value_counts(df, "grp", "v"), QS, partitions=partitions).collect()}
    assert "none" not in got and None not in got
    for g in got:
        own = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g].n_values == len(own)
        assert np.allclose([got[g][q] for q in QS], np.quantile(own, list(QS.values())))


def test_merged_counts_equal_the_whole(spark):
    rng = random.Random(7)
    rows = [(f"g{rng.randrange(2)}", rng.random()) for _ in range(600)]
    df = spark.createDataFrame(rows, "grp string, v double")
    parts = [value_counts(spark.createDataFrame(rows[k::3], df.schema), "grp", "v") for k in range(3)]
    want = sorted(tuple(r) for r in group_percentiles(df, "grp", "v", QS).collect())
    assert sorted(tuple(r) for r in percentiles_from_counts(merge_counts(*parts), QS).collect()) == want


def test_resolution_bounds_the_error(spark):
    rng = random.Random(8)
    rows = [("g", rng.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "grp string, v double")
    counts = value_counts(df, "grp", "v", resolution=0.01)
    assert counts.count() <= 101
    got = percentiles_from_counts(counts, QS).first()
    assert np.abs(np.array([got[q] for q in QS]) - np.quantile([v for _, v in rows], list(QS.values()))).max() <= 0.005 + 1e-9


def test_empty(spark):
    assert group_percentiles(spark.createDataFrame([], "grp string, v double"), "grp", "v", QS).count() == 0
