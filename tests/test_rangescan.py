import random

from pulseframe.operators.graph import connected_components
from pulseframe.operators.rangescan import exclusive_scan, number_rows


def test_number_rows_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(20), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {(r.k, r.v): r.rank for r in number_rows(df, "k", ["v"], partitions=7).collect()}
    for k in {k for k, _ in rows}:
        vs = sorted(v for a, v in rows if a == k)
        assert [got[k, v] for v in vs] == list(range(len(vs)))


def test_number_rows_empty(spark):
    assert number_rows(spark.createDataFrame([], "k long, v long"), "k", ["v"], partitions=3).count() == 0


def test_exclusive_scan_across_blocks(spark):
    rows = [(p, "a", p if p % 3 else None) for p in range(20)]
    e = spark.createDataFrame(rows, "pid int, k string, v int")
    last = {r.pid: r.o for r in exclusive_scan(e, ["k"], "v", "last", "o", block=4).collect()}
    nxt = {r.pid: r.o for r in exclusive_scan(e, ["k"], "v", "last", "o", reverse=True, block=4).collect()}
    total = {r.pid: r.o for r in exclusive_scan(e, ["k"], "v", "sum", "o", block=4).collect()}
    for p in range(20):
        assert last[p] == next((v for _, _, v in reversed(rows[:p]) if v is not None), None)
        assert nxt[p] == next((v for _, _, v in rows[p + 1 :] if v is not None), None)
        assert total[p] == (sum(v or 0 for _, _, v in rows[:p]) if any(v is not None for _, _, v in rows[:p]) else None)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1064)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame([*edges, (None, 3), (5, None), edges[0]], "a long, b long")).collect()}
    assert {v: got[v] for v in parent} == {v: root(v) for v in parent}
