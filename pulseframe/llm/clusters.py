"""Groups of mutually similar numeric records within a source.

A record is a set of tokens: for each feature the ``WINDOW`` consecutive grid lines from its value
on, in steps of a fraction of the source's own spread. The Jaccard similarity of two such sets falls
with the summed distance of their values, so MinHash banding finds candidate pairs, the exact
Jaccard similarity verifies them and connected components are the groups. Records with one token
set are one node.

Nodes are dealt to tiles of the feature space (with a halo as wide as the link reaches), so the
number of nodes in a task is bounded by the grid whatever the size of a source; components of
neighbouring tiles are joined through the nodes they share.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..scratch import materialize

#: Grid steps per unit of spread, tokens per feature, and the similarity from which two records are linked.
STEPS, WINDOW, LINK = 4, 24, 0.67
#: A tile's side in grid steps.
TILE = 128
BANDS, ROWS = 12, 2
LEAST = 5
#: A component is loose if less than this share of its members is near its medoid.
TIGHT = 0.75
#: Near is closer than WINDOW steps in sum over the features, so no feature's tokens are wholly disjoint: a Jaccard similarity above 0.5.
CORE_REACH = WINDOW - 1
#: Nodes of a loose component that one task splits; rounds of larger ones before their settled rows are written as one table.
LOCAL, _COMPACT = 50_000, 16
_SHARE = 10  # of 40 quantile steps: the shortest stretch with a quarter of the values


def spreads(df: DataFrame, source: str, features: list[str]) -> DataFrame:
    """(source, s_<feature>...): the width of the shortest stretch that holds a quarter of a source's values.

    As wide as a normal distribution's with spread 1; robust against outliers and several states.
    """
    qs = F.array(*[F.lit(i / 40) for i in range(41)])
    q = df.groupBy(source).agg(*[F.percentile_approx(f, qs, 2000).alias(f"q_{f}") for f in features])

    def short(c):
        return F.array_min(F.transform(F.sequence(F.lit(1), F.lit(41 - _SHARE)), lambda i: F.element_at(c, i + _SHARE) - F.element_at(c, i))) / 0.637

    whole = lambda c: F.element_at(c, 41) - F.element_at(c, 1)
    # values so coarse that a quarter of them agree: a tenth of the range, or any unit if all agree
    return q.select(source, *[F.when(short(F.col(f"q_{f}")) > 0, short(F.col(f"q_{f}"))).when(whole(F.col(f"q_{f}")) > 0, whole(F.col(f"q_{f}")) / 10).otherwise(1.0).alias(f"s_{f}") for f in features])


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of the token sets of nodes with grid positions a and b (n x features)."""
    d = np.minimum(np.abs(a - b), WINDOW).sum(1)
    total = WINDOW * a.shape[1]
    return (total - d) / (total + d)


def _minhash(lines: list[tuple[np.ndarray, np.ndarray]], seed: int) -> np.ndarray:
    """One MinHash of every node's tokens; ``lines`` has each feature's distinct positions and their inverse."""
    best = None
    for f, (q, inverse) in enumerate(lines):
        h = (q[:, None] + np.arange(WINDOW)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0x632BE59BD9B4E019 + f * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        least = h.min(1)[inverse]
        best = least if best is None else np.minimum(best, least)
    return best


class _Union:
    def __init__(self, n):
        self.p = np.arange(n)

    def join(self, a, b):
        """Union of many pairs: labels fall to the smallest of their component."""
        while len(a):
            x, y = self.p[a], self.p[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.p, high, low)
            self.flatten()
            keep = self.p[a] != self.p[b]
            a, b = a[keep], b[keep]

    def flatten(self):
        while True:
            q = self.p[self.p]
            if np.array_equal(q, self.p):
                return
            self.p = q


def _pairs(start: np.ndarray, size: np.ndarray, order: np.ndarray, step: int = 4_000_000):
    """All pairs within the stretches of ``order`` given by start and size, in bounded portions."""
    if not len(size):
        return
    index = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(start, size) + index
    todo = np.repeat(size, size) - 1 - index
    first = 0
    total = np.cumsum(todo)
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + step, "right")))
        k, a = todo[first:last], at[first:last]
        left = np.repeat(a, k)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        yield order[left], order[right]
        first = last


def link(space: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Component of every node (as the index of its first node): candidate pairs by banding, verified exactly.

    ``space`` numbers the tile of each node; nodes of different tiles are never linked. Buckets whose
    nodes are joined already need no more pairs; of the others every pair of different components is verified.
    """
    u = _Union(len(q))
    by = np.argsort(q[:, 0], kind="stable")
    lines = [np.unique(q[:, f], return_inverse=True) for f in range(q.shape[1])]
    for band in range(BANDS):
        key = space.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for r in range(ROWS):
            key = (key ^ _minhash(lines, band * ROWS + r + 1)) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(31)
        order = by[np.argsort(key[by], kind="stable")]
        k = key[order]
        same = k[1:] == k[:-1]
        a, b = order[:-1][same], order[1:][same]
        ok = jaccard(q[a], q[b]) >= LINK
        u.join(a[ok], b[ok])
        start = np.flatnonzero(np.concatenate(([True], ~same)))
        size = np.diff(np.append(start, len(k)))
        label = u.p[order]
        mixed = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start) if len(k) else np.array([], bool)
        for a, b in _pairs(start[mixed], size[mixed], order):
            apart = u.p[a] != u.p[b]
            a, b = a[apart], b[apart]
            ok = (jaccard(q[a], q[b]) >= LINK) & (space[a] == space[b])
            u.join(a[ok], b[ok])
    return u.p


def reach(features: int) -> int:
    """How far a link reaches at most: mW(1-J)/(1+J) steps in sum over m features."""
    return int(np.floor(features * WINDOW * (1 - LINK) / (1 + LINK) + 1e-9))


def _degrees(space: np.ndarray, q: np.ndarray, n: np.ndarray, rows: int = 256) -> np.ndarray:
    """Records linked with each node: exact Jaccard similarity of at least LINK, other records of the same node included.

    Nodes are sorted by tile and first feature and compared in portions with the stretch that a link can reach.
    """
    far = reach(q.shape[1])
    # positions within a tile fit in 16 bits, sums of their differences as well
    most = 16_000 // q.shape[1]
    order = np.lexsort((q[:, 0], space))
    s, p, held = space[order], q[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    out = np.zeros(len(q))
    for a, z in zip(start, np.append(start[1:], len(s))):
        x = np.clip(p[a:z] - np.median(p[a:z], axis=0).astype(np.int64), -most, most).astype(np.int16)
        for lo in range(0, z - a, rows):
            hi = min(lo + rows, z - a)
            b, e = np.searchsorted(x[:, 0], (int(x[lo, 0]) - far, int(x[hi - 1, 0]) + far + 1))
            d = np.abs(x[lo:hi, None, 0] - x[None, b:e, 0])
            for f in range(1, x.shape[1]):
                d += np.abs(x[lo:hi, None, f] - x[None, b:e, f])
            out[a + lo : a + hi] = (d <= far) @ held[a + b : a + e]
    degree = np.empty(len(q))
    degree[order] = out - 1
    return degree


def _tiles(batches):
    """Local components of all tiles of a partition, a few hundred thousand nodes at a time."""
    held, rows = [], 0

    def done(parts):
        t = pa.Table.from_batches(parts)
        # a tile's number is a hash, so the source is looked at beside it; tiles of one source that share a number do no harm
        source = t["source"].combine_chunks().dictionary_encode().indices.to_numpy()
        space = np.unique(np.column_stack((t["tile"].to_numpy(), source)), axis=0, return_inverse=True)[1].ravel()
        names = [c for c in t.column_names if c.startswith("q_")]
        q = np.column_stack([t[c].to_numpy() for c in names])
        node = t["node"].to_numpy()
        by = np.lexsort((node, space))
        space, q, node = space[by], q[by], node[by]
        label = node[link(space, q)]
        degree = _degrees(space, q, t["n"].to_numpy()[by].astype(float))
        t = t.take(pa.array(by)).drop_columns(["tile"]).append_column("label", pa.array(label)).append_column("degree", pa.array(degree))
        # of another tile's nodes only the label is needed
        return t.filter(pc.or_(t["own"], t["shared"])).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        # batches end anywhere, tiles must not be torn: cut at the last change of tile
        tile = b.column("tile").to_numpy()
        cut = np.flatnonzero(tile[1:] != tile[:-1])
        if rows >= 200_000 and len(cut):
            k = int(cut[0]) + 1
            yield from done([*held, b.slice(0, k)])
            held, rows = [b.slice(k)], b.num_rows - k
        else:
            held.append(b)
            rows += b.num_rows
    if held:
        yield from done(held)


def similarity_groups(df: DataFrame, features: list[str], *, source: str = "source", id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Groups of similar records per source.

    ``df``: ``source`` (string), ``id`` (bigint, unique per record) and the double columns ``features``.
    Records with a null source or id, or a feature that is null, NaN or infinite, belong to no group;
    repeated ids count once. Result: members (source, id, group_id, degree) and groups (source,
    group_id, n_members, typical), where group_id is the smallest id of a group, groups have at least
    five members, and typical lists up to three ids of highest degree (most records linked; ties by
    id). An empty table gives no rows.
    """
    names = [f"q_{f}" for f in features]
    usable = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < 1e300) for f in features])
    rows = df.select(F.col(source).cast("string").alias("source"), F.col(id).cast("long").alias("id"), *[F.col(f).cast("double").alias(f) for f in features])
    once = materialize(rows.filter(usable & F.col("source").isNotNull() & F.col("id").isNotNull()).dropDuplicates(["id"]), "records")
    scale = spreads(once, "source", features)
    # grid positions beyond 2^40 steps are one far cell
    grid = [F.greatest(F.lit(-(1 << 40)), F.least(F.lit(1 << 40), F.floor(F.col(f) * STEPS / F.col(f"s_{f}")))).cast("long").alias(f"q_{f}") for f in features]
    placed = materialize(once.join(scale, "source").select("source", "id", *grid), "placed")
    nodes = placed.groupBy("source", *names).agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    tile = lambda c, by: F.floor((F.col(c) + by) / TILE)
    spots = [F.array_distinct(F.array(tile(c, 0), tile(c, -reach(len(names))), tile(c, reach(len(names))))) for c in names]
    cut = nodes
    for i, s in enumerate(spots):
        cut = cut.withColumn(f"t{i}", F.explode(s))
    home = reduce(lambda a, b: a & b, [F.col(f"t{i}") == tile(c, 0) for i, c in enumerate(names)])
    many = reduce(lambda a, b: a | b, [F.size(s) > 1 for s in spots])
    cut = cut.select(F.xxhash64("source", *[f"t{i}" for i in range(len(names))]).alias("tile"), "source", "node", "n", home.alias("own"), many.alias("shared"), *names)
    local = cut.repartition("tile").sortWithinPartitions("tile")
    schema = "source string, node long, n long, own boolean, shared boolean, " + ", ".join(f"{c} long" for c in names) + ", label long, degree double"
    found = materialize(local.mapInArrow(_tiles, schema), "tiles")
    # a node seen in several tiles joins their components
    seen = found.filter("shared").alias("x")
    here = found.filter("shared and own").alias("y")
    merged = connected_components(seen.join(here, F.col("x.node") == F.col("y.node")).select(F.col("x.label").alias("a"), F.col("y.label").alias("b")).filter("a != b").distinct())
    own = found.filter("own")
    merged = merged.select(F.col("node").alias("was"), F.col("label").alias("whole"))
    at = own.join(merged, own["label"] == merged["was"], "left").select("source", *names, "node", "n", F.coalesce("whole", "label").alias("comp"), "degree")
    at = materialize(at, "nodes")
    at = _split_loose(at, names)
    members = materialize(placed.join(at.select("source", *names, "comp", "degree"), ["source", *names]).select("source", "id", "comp", "degree"), "members")
    # the best of every salt, then the best three of the group: no group is collected
    part = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32))).groupBy("comp", "salt").agg(
        F.first("source").alias("source"), F.count(F.lit(1)).alias("n"), F.min("id").alias("g"), F.min(F.struct((-F.col("degree")).alias("d"), "id")).alias("best")
    )
    groups = part.groupBy("comp").agg(F.first("source").alias("source"), F.sum("n").alias("n_members"), F.min("g").alias("group_id"), F.slice(F.array_sort(F.collect_list("best")), 1, 3).alias("top"))
    groups = materialize(groups.filter(F.col("n_members") >= LEAST), "groups")
    out = groups.select("source", "group_id", "n_members", F.transform("top", lambda x: x["id"]).alias("typical"))
    return members.join(groups.select("comp", "group_id"), "comp").select("source", "id", "group_id", "degree"), out


def _peel(names: list[str]):
    """Split one loose component in memory, as ``_split_loose`` does in rounds."""

    def run(pdf):
        pdf = pdf.iloc[np.lexsort((pdf["node"], -pdf["degree"]))]
        q, n, node = pdf[names].to_numpy(), pdf["n"].to_numpy(), pdf["node"].to_numpy()
        comp, left = pdf["comp"].to_numpy().copy(), np.arange(len(pdf))
        while len(left):
            near = np.minimum(np.abs(q[left] - q[left[0]]), WINDOW).sum(1) <= CORE_REACH
            if n[left[near]].sum() >= TIGHT * n[left].sum():
                near[:] = True
            comp[left[near]] = node[left[near]].min()
            left = left[~near]
        return pdf.assign(comp=comp)

    return run


def _split_loose(at: DataFrame, names: list[str]) -> DataFrame:
    """Split components held together by chains: around the medoid of highest degree, again for the rest, until none is loose.

    Every round settles the records near the medoid of each loose component (the medoid at least), so the
    loop ends; loose components of up to ``LOCAL`` nodes are split by one task each. Only components whose
    extent reaches beyond ``CORE_REACH`` are looked at.
    """

    def near():
        return reduce(lambda a, b: a + b, [F.least(F.lit(WINDOW), F.abs(F.col(c) - F.col(f"m.{c}"))) for c in names]) <= CORE_REACH

    def loose(df):
        best = df.groupBy("comp").agg(F.min(F.struct((-F.col("degree")).alias("d"), "node", *names)).alias("m"), *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))])
        far = reduce(lambda a, b: a + b, [F.least(F.lit(WINDOW), F.greatest(F.col(f"hi_{c}") - F.col(f"m.{c}"), F.col(f"m.{c}") - F.col(f"lo_{c}"))) for c in names])
        j = df.join(best.filter(far > CORE_REACH).select("comp", "m"), "comp").withColumn("near", near())
        share = F.sum(F.when(F.col("near"), F.col("n")).otherwise(0)) / F.sum("n")
        cut = j.groupBy("comp").agg(share.alias("share"), F.min(F.when(~F.col("near"), F.col("node"))).alias("rest"), F.min(F.when(F.col("near"), F.col("node"))).alias("ball"), F.first("m").alias("m"), F.count(F.lit(1)).alias("nodes"))
        return materialize(cut.filter(F.col("share") < TIGHT).select("comp", "rest", "ball", "m", "nodes"), "loose")

    part, done = at, []
    while (cut := loose(part)).limit(1).count():
        done.append(part.join(cut, "comp", "left_anti").select(*at.columns))
        small = part.join(cut.filter(F.col("nodes") <= LOCAL), "comp", "left_semi").select(*at.columns)
        done.append(materialize(small.groupBy("comp").applyInPandas(_peel(names), at.schema), "peeled"))
        if not (large := cut.filter(F.col("nodes") > LOCAL)).limit(1).count():
            return reduce(DataFrame.unionByName, done)
        split = materialize(part.join(large, "comp").withColumn("near", near()).select(*at.columns, "rest", "ball", "near"), "split")
        # either part is known by its own smallest node: the whole's may lie in the other
        done.append(split.filter("near").withColumn("comp", F.col("ball")).select(*at.columns))
        part = split.filter("not near").withColumn("comp", F.col("rest")).select(*at.columns)
        if len(done) > 3 * _COMPACT:
            done = [materialize(reduce(DataFrame.unionByName, done), "settled")]
    return reduce(DataFrame.unionByName, done, part)
