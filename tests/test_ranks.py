import random

import pytest

from pulseframe.operators import ranks


def table(spark, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice(("x", "y", "z")), float(rng.randrange(40))) for _ in range(500)] + [("a", "x", None), (None, "x", 3.0)]
    return rows, spark.createDataFrame(rows, "g string, l string, v double")


@pytest.mark.parametrize("hot_bytes", [0, 1 << 62])
@pytest.mark.parametrize("group", [["g"], []])
def test_average_ranks(spark, hot_bytes, group):
    rows, df = table(spark)
    got = {(r.g if group else 0, r.v): (r.n, r.rank) for r in ranks.average_ranks(df, "v", group, hot_bytes=hot_bytes).collect()}
    for g in {r[0] for r in rows} if group else {0}:
        own = sorted(v for a, _, v in rows if v is not None and (not group or a == g))
        for v in set(own):
            at = [i + 1 for i, x in enumerate(own) if x == v]
            assert got[g, v] == (len(at), sum(at) / len(at))


def test_mann_whitney_against_pairs(spark):
    rows, df = table(spark, 2)
    x, y = ([v for _, l, v in rows if l == k and v is not None] for k in "xy")
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    r = ranks.mann_whitney(df, "v", "l", "x", "y").first()
    assert (r.n1, r.n2, r.u) == (len(x), len(y), u) and abs(r.r - (1 - 2 * u / len(x) / len(y))) < 1e-12


def test_benjamini_hochberg(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.04, None]
    got = sorted((r.i, r.q) for r in ranks.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect())
    full = [1.0 if v is None else v for v in p]
    for i, q in got:
        assert abs(q - min(1.0, *(v * 6 / sum(w <= v for w in full) for v in full if v >= full[i]))) < 1e-12
