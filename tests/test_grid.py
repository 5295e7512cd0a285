import math
import random

from pulseframe.operators import grid
from pulseframe.operators.grid import regular_grid

R, S = "source string, t double, v double", "source string, duration_ms double"


def run(spark, readings, spans, kind="number", gap=5, schema=R):
    out = regular_grid(spark.createDataFrame(readings, schema), spark.createDataFrame(spans, S), 1000.0, gap, kind).collect()
    return {(r.source, r.slot_no): (r.status, r.value) for r in out}


def test_interpolates_within_the_gap_limit(spark):
    got = run(spark, [("a", 500.0, 0.0), ("a", 4500.0, 4.0), ("a", 500.0, 0.0)], [("a", 12_000.0), ("a", None)])
    assert [got["a", k][0] for k in range(12)] == ["observed", "filled", "filled", "filled", "observed"] + ["missing"] * 7
    assert [got["a", k][1] for k in range(5)] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_bad_readings_and_sources(spark):
    nan = float("nan")
    got = run(spark, [("a", -1.0, 1.0), ("a", 3000.0, 1.0), ("a", nan, 1.0), ("a", None, 1.0), ("a", 1.0, nan), ("a", 1.0, None), (None, 1.0, 1.0), ("z", 1.0, 1.0)], [("a", 2500.0), ("b", 0.0), ("c", nan), ("d", None), (None, 5.0)])
    assert got == {("a", k): ("missing", None) for k in range(3)}


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [], [("a", 1.0)]) == {("a", 0): ("missing", None)}


def test_labels_take_the_nearer_neighbour(spark):
    got = run(spark, [("a", 100.0, "low"), ("a", 3900.0, "high")], [("a", 5000.0)], "label", 5, "source string, t double, v string")
    assert [got["a", k] for k in range(5)] == [("observed", "low"), ("filled", "low"), ("filled", "high"), ("observed", "high"), ("filled", "high")]


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(5)
    readings = [(s, rng.uniform(0, 300_000), rng.uniform(0, 9)) for s in "ab" for _ in range(120)]
    spans = [("a", 300_000.0), ("b", 250_500.0)]
    whole = run(spark, readings, spans)
    monkeypatch.setattr(grid, "BLOCK", 16)
    cut = run(spark, readings, spans)
    assert whole.keys() == cut.keys()
    for k, (status, value) in whole.items():
        assert cut[k][0] == status and (value == cut[k][1] or math.isclose(value, cut[k][1]))
    held = {(s, int(t // 1000)) for s, t, _ in readings if t < dict(spans)[s]}
    assert {k for k, v in whole.items() if v[0] == "observed"} == held
