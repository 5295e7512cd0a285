import json
from itertools import permutations

import numpy as np

from pulseframe.operators.drift import best_matching, canonical_names, layout_changes, parse_lines, unified_table

SCHEMA = "export_id long, recording_id string, ver_no int, line_no int, payload string"


def table(spark, versions):
    rows = [(100 + i, "r", i + 1, k, p if isinstance(p, str) else json.dumps(p)) for i, v in enumerate(versions) for k, p in enumerate(v)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, *versions):
    return {(r.export_id - 99, r.change_kind, r.old_field, r.new_field) for r in layout_changes(parse_lines(table(spark, versions))).collect()}


def spikes(n=12):
    rng = np.random.default_rng(0)
    return [{"spk_id": i, "t_ms": round(float(rng.uniform(0, 9000)), 3), "r2": round(float(rng.random()), 5), "q2": round(float(rng.random()), 5), "grp": ("low", "mid", "high")[i % 3]} for i in range(n)]


def test_no_change_and_broken_lines(spark):
    a = spikes()
    assert changes(spark, a, [*a[::-1], a[0], '{"spk_id": 3, "t_', "", "[1]", "null"]) == set()


def test_rename_in_another_unit_and_notation(spark):
    a = spikes()
    b = [{"spk_id": r["spk_id"], "time_s": r["t_ms"] / 1000, "fit": r["r2"], "q2": r["q2"], "code": ("low", "mid", "high").index(r["grp"])} for r in a]
    assert changes(spark, a, b) == {(2, "renamed", "t_ms", "time_s"), (2, "renamed", "r2", "fit"), (2, "renamed", "grp", "code"), (2, "retyped", "grp", "code")}


def test_added_and_removed_are_no_rename(spark):
    a = spikes()
    b = [{k: v for k, v in r.items() if k != "r2"} | {"n_iter": i * 7 % 5} for i, r in enumerate(a)]
    assert changes(spark, a, b) == {(2, "removed", "r2", ""), (2, "added", "", "n_iter")}


def test_retyped_nested_and_null(spark):
    a = spikes()
    b = [r | {"r2": str(r["r2"]), "q2": None} for r in a]
    c = [{k: v for k, v in r.items() if k != "q2"} | {"fit_q": {"value": r["q2"], "n": 60}} for r in a]
    got = changes(spark, a, b, a, c)
    assert (2, "retyped", "r2", "r2") in got and (3, "retyped", "r2", "r2") in got
    assert not any(x[2] == "q2" and x[0] == 2 for x in got)
    assert {x for x in got if x[0] == 4} == {(4, "renamed", "q2", "fit_q"), (4, "retyped", "q2", "fit_q")}


def test_missing_version_and_empty(spark):
    df = spark.createDataFrame([(1, "r", 1, 0, '{"spk_id": 1, "a": 1}'), (2, "r", 3, 0, '{"spk_id": 1, "b": 1}')], SCHEMA)
    assert layout_changes(parse_lines(df)).count() == 0
    assert layout_changes(parse_lines(spark.createDataFrame([], SCHEMA))).count() == 0


def test_unified_table(spark):
    a = spikes()
    b = [{("fit" if k == "r2" else k): v for k, v in r.items()} for r in a]
    lines = parse_lines(table(spark, [a, a, b]))
    names = canonical_names(layout_changes(lines), lines)
    assert names["fit"][0] == "r2"
    t = unified_table(lines, names)
    assert t.count() == 36 and t.filter("r2 is null").count() == 0 and "fit" not in t.columns


def test_unified_table_in_one_unit_and_notation(spark):
    a = spikes(30)
    code = {"low": 0, "mid": 1, "high": 2}
    b = [{"spk_id": r["spk_id"], "time_s": round(r["t_ms"] / 1000, 6), "r2": r["r2"], "q2": r["q2"], "code": code[r["grp"]]} for r in a]
    c = [{k: v for k, v in r.items() if k != "q2"} | {"fit_q": {"value": r["q2"], "n": 60}} for r in a]
    clash = [dict(r, time_s=1.0) if i == 0 else r for i, r in enumerate(a)]
    lines = parse_lines(table(spark, [a, b, a, c, clash]))
    t = unified_table(lines, canonical_names(layout_changes(lines), lines))
    assert dict(t.dtypes)["t_ms"] == "double" and dict(t.dtypes)["spk_id"] == "bigint" and dict(t.dtypes)["q2"] == "double"
    want = {r["spk_id"]: r for r in a}
    for r in t.filter("ver_no < 5").collect():
        w = want[r.spk_id]
        assert abs(r.t_ms - w["t_ms"]) < 1e-6 and r.grp == w["grp"] and r.r2 == w["r2"] and r.q2 == w["q2"] and not r.conflicts
    odd = [r for r in t.filter("ver_no = 5").collect() if r.conflicts]
    assert len(odd) == 1 and odd[0].t_ms == want[0]["t_ms"] and set(odd[0].conflicts["t_ms"].values()) == {str(want[0]["t_ms"]), "1000.0"}


def test_matching_against_brute_force():
    rng = np.random.default_rng(4)
    for n, m in ((1, 3), (3, 3), (4, 2), (5, 5)):
        w = np.round(rng.random((n, m)), 3)
        got = sum(w[i, j] for i, j in best_matching(w))
        pad = np.zeros((max(n, m), max(n, m)))
        pad[:n, :m] = w
        assert np.isclose(got, max(sum(pad[i, j] for i, j in enumerate(p)) for p in permutations(range(len(pad)))))
