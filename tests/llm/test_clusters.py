import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import clusters
from pulseframe.llm.clusters import jaccard, link, similarity_groups

FEATURES = ["x", "y", "z"]
SCHEMA = "source string, id long, x double, y double, z double"


def blobs(seed=1):
    rng = np.random.default_rng(seed)
    rows, truth, i = [], {}, 0
    for s, centres in {"a": [(0, 0, 0), (30, 5, 0)], "b": [(5, 5, 5)], "c": [(0, 0, 0), (0, 20, 0), (25, 25, 9)]}.items():
        for c in centres:
            first = i
            for p in rng.normal(c, 0.8, (120, 3)):
                rows.append((s, i, *map(float, p)))
                truth[i] = first
                i += 1
        rows.append((s, i, 500.0, -400.0, 90.0))
        i += 1
    return rows, truth


@pytest.mark.parametrize("tile", [32, 128])
def test_groups_and_outliers(spark, monkeypatch, tile):
    monkeypatch.setattr(clusters, "TILE", tile)
    rows, truth = blobs()
    n = len(rows)
    nan = float("nan")
    extra = [rows[3], rows[3], ("a", n + 1, None, 0.0, 0.0), ("a", n + 2, nan, 0.0, 0.0), ("a", n + 3, float("inf"), 0.0, 0.0), (None, n + 4, 0.0, 0.0, 0.0), ("a", None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + extra, SCHEMA).withColumn("node", F.lit(1)).withColumn("comp", F.lit(2))
    members, groups = similarity_groups(df, FEATURES)
    got = {r.id: r.group_id for r in members.collect()}
    missing = [i for i in truth if i not in got]
    assert len(missing) <= 0.02 * len(truth)
    assert all(got[i] == min(j for j in got if truth[j] == truth[i]) for i in got)
    g = {r.group_id: r for r in groups.collect()}
    assert len(g) == 6 and sum(r.n_members for r in g.values()) == len(got)
    assert all(1 <= len(r.typical) <= 3 and all(got[i] == r.group_id for i in r.typical) for r in g.values())


def test_small_groups_and_empty(spark):
    rows = [("a", i, 1.0, 1.0, 1.0) for i in range(4)] + [("b", 10 + i, 1.0, 1.0, 1.0) for i in range(5)]
    members, _ = similarity_groups(spark.createDataFrame(rows, SCHEMA), FEATURES)
    assert sorted((r.id, r.group_id) for r in members.collect()) == [(10 + i, 10) for i in range(5)]
    assert similarity_groups(spark.createDataFrame([], SCHEMA), FEATURES)[0].count() == 0


def test_banding_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(4)
    q = rng.integers(0, 150, (400, 3))
    space = rng.integers(0, 2, 400)
    sim = jaccard(np.repeat(q, 400, 0), np.tile(q, (400, 1))).reshape(400, 400)
    linked = (sim >= clusters.LINK) & (space[:, None] == space[None, :])
    label = np.arange(400)
    for _ in range(400):
        new = np.where(linked, label[None, :], 400).min(1)
        if np.array_equal(new, label):
            break
        label = new
    got = link(space, q)
    # exact on the pairs it proposes; recall of the components against brute force
    same_got, same = got[:, None] == got[None, :], label[:, None] == label[None, :]
    assert not (same_got & ~same).any()
    assert (same_got & same).sum() >= 0.99 * same.sum()


def test_exact_jaccard():
    tokens = lambda p: {(f, v + w) for f, v in enumerate(p) for w in range(clusters.WINDOW)}
    rng = np.random.default_rng(5)
    for a, b in rng.integers(0, 40, (50, 2, 3)):
        x, y = tokens(a.tolist()), tokens(b.tolist())
        assert np.isclose(jaccard(a[None], b[None])[0], len(x & y) / len(x | y))


def test_only_splitting_parts_a_chain(spark, monkeypatch):
    """Two dense states joined by a chain of bridging records are one component; the split alone parts them."""
    rng = np.random.default_rng(8)
    rows = [("a", i, *map(float, p)) for i, p in enumerate(np.vstack((rng.normal((0, 0, 0), 1, (200, 3)), rng.normal((40, 0, 0), 1, (200, 3)))))]
    rows += [("a", 500 + i, float(x), 0.0, 0.0) for i, x in enumerate(np.arange(1, 40, 1.0))]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = lambda: sorted(r.n_members for r in similarity_groups(df, FEATURES)[1].collect())
    assert (got := sizes()) and len(got) >= 2 and got[-2] >= 180
    monkeypatch.setattr(clusters, "TIGHT", 0.0)
    assert len(sizes()) == 1


@pytest.mark.parametrize("m", [2, 3, 5])
def test_degrees_are_verified_links(m):
    rng = np.random.default_rng(9)
    q, space, n = rng.integers(0, 40, (300, m)), rng.integers(0, 3, 300), rng.integers(1, 4, 300).astype(float)
    q[0, 0] = 1 << 39
    sim = np.array([[jaccard(a[None], b[None])[0] for b in q] for a in q])
    linked = (sim >= clusters.LINK) & (space[:, None] == space[None, :])
    assert np.array_equal(clusters._degrees(space, q, n), linked @ n - 1)
    apart = np.abs(q[:, None] - q[None]).sum(2)
    assert apart[sim >= clusters.LINK].max() <= clusters.reach(m)


@pytest.mark.parametrize("local", [50_000, 0])
def test_states_far_apart_in_one_feature_are_split_for_good(spark, monkeypatch, local):
    monkeypatch.setattr(clusters, "LOCAL", local)
    rng = np.random.default_rng(7)
    rows = [("a", i, *map(float, p)) for i, p in enumerate(np.vstack((rng.normal((0, 0, 0), 1, (300, 3)), rng.normal((15, 0, 0), 1, (200, 3)))))]
    # bridging spikes join the two states
    rows += [("a", 600 + i, float(x), 0.0, 0.0) for i, x in enumerate(np.arange(0.5, 15, 0.5))]
    # a long thin chain leaves a dense state: more balls around medoids than the 20 rounds once allowed
    rows += [("b", 1000 + i, *map(float, p)) for i, p in enumerate(rng.normal((0, 0, 0), 1, (250, 3)))]
    rows += [("b", 2000 + i, 2.0 + 2.4 * i, 0.0, 0.0) for i in range(110 if local else 85)]
    got = {r.id: r.group_id for r in similarity_groups(spark.createDataFrame(rows, SCHEMA), FEATURES)[0].collect()}
    first, second = ([got.get(i) for i in ids] for ids in (range(300), range(300, 500)))
    most = [max(set(g), key=g.count) for g in (first, second)]
    assert most[0] != most[1] and first.count(most[0]) >= 290 and second.count(most[1]) >= 190
    assert max([sum(got.get(i) == g for i in range(2010, 2110)) for g in set(got.values())]) <= 10
