"""Implausible readings in ordered measurements, against what each source normally shows.

Spikes are found by phase-space thresholding: readings outside of a robust, tilted ellipsoid over value,
first and second difference are flagged, the farthest of neighbouring ones first, and replaced by the
middle of the source until nothing is outside. The bulk of the source's own values gives the scale.
Sources switch between states, and a switch is a large difference but no fault, so the difference axes
are never narrower than the bulk, within which all switches lie. Runs of zero differences too long for
chance, impossible values and times out of order are caught beside it.

The bulk and all counts are taken over a whole source. For what depends on neighbouring readings a source
is cut into blocks of ``BLOCK_ROWS`` readings by their number, with ``HALO`` more on both sides, so it may
hold any share of the rows; runs that cross the border of a block are put together.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .rangescan import number_rows

#: Readings of a source that one task judges together, and those it sees beyond on either side.
BLOCK_ROWS, HALO = 50_000, 2_500
#: Half an axis of the ellipsoid, in widths of the bulk.
AXIS = 2.0
#: Share of the readings left out of the bulk on either side, and one reading at least; further shares for which percentiles are kept, as flagged readings are left out, too; accuracy of approximate percentiles (exact for fewer readings).
TAIL, SHARES, ACCURACY = 0.04, tuple(round(0.0401 + 0.01 * k, 4) for k in range(27)), 10_000
#: Equal readings of a run at least, and how often such a run may be expected by chance in the whole source.
RUN, CHANCE = 4, 0.05


class Bulk:
    """Edges and middle of what a source normally shows, from its ``n`` and its percentiles at SHARES, one half and 1 - SHARES."""

    def __init__(self, n: int, quantiles):
        self.n, self.q = n, np.asarray(quantiles, float)

    @classmethod
    def of(cls, u: np.ndarray) -> Bulk:
        s, p = np.sort(u), np.array([*SHARES, 0.5, *(1 - x for x in SHARES)])
        return cls(len(u), s[np.clip(np.ceil(p * len(u)).astype(int) - 1, 0, len(u) - 1)] if len(u) else [])

    def edges(self, below: float = 0.0, above: float = 0.0) -> tuple[float, float, float]:
        """Lower edge, middle and upper edge without the shares of flagged readings on both sides."""
        m = len(SHARES)

        def at(flagged):
            share = max(TAIL * (1 - below - above) + flagged, flagged + 1.0001 / self.n)
            return min(int(np.searchsorted(SHARES, share)), m - 1)

        return float(self.q[at(below)]), float(self.q[m]), float(self.q[m + 1 + at(above)])


def _distance(w: np.ndarray, bulk: tuple[float, float, float], differences: bool) -> np.ndarray:
    """Square of every reading's distance from the middle of the ellipsoid, whose surface is at 1."""
    lo, middle, hi = bulk
    width = max(hi - lo, 1e-6 * max(abs(lo), abs(hi)), 1e-300)
    x = (w - (lo + hi) / 2) / width
    if not differences:
        return (x / AXIS) ** 2
    before, after = np.concatenate((x[:1], x[:-1])), np.concatenate((x[1:], x[-1:]))
    first, second = (after - before) / 2, x - (before + after) / 2
    normal = np.abs(x) <= 0.5
    # the tilt of value against second difference, from the bulk only
    a, b = x[normal], second[normal]
    spread = float((a * a).sum()) if len(a) else 0.0
    tilt = np.arctan(float((a * b).sum()) / spread) if spread > 0 else 0.0
    along, across = x * np.cos(tilt) + second * np.sin(tilt), second * np.cos(tilt) - x * np.sin(tilt)

    def axis(v):  # bulk of the normal readings' own values, never narrower than the bulk of the source
        k = v[normal]
        return AXIS * max(1.0, float(np.subtract(*np.quantile(k, (0.96, 0.04)))) if len(k) else 1.0)

    return (along / axis(along)) ** 2 + (first / axis(first)) ** 2 + (across / axis(across)) ** 2


def spikes(u: np.ndarray, bulk: Bulk | None = None, differences: bool = True) -> np.ndarray:
    """Phase-space thresholding of a finite series; a mask of the spikes. Ends when no reading is outside."""
    bad = np.zeros(len(u), bool)
    bulk = Bulk.of(u) if bulk is None else bulk
    if bulk.n < 8 or not len(u):
        return bad
    w, middle = u.astype(float), bulk.q[len(SHARES)]
    while True:
        low = float((bad & (u < middle)).mean())
        far = np.where(bad, 0.0, _distance(w, bulk.edges(low, float(bad.mean()) - low), differences))
        outside = far > 1
        if not outside.any():
            return bad
        # a spike pushes its neighbours outside, too: they are looked at again without it
        new = outside & (far >= np.concatenate(([0], far[:-1]))) & (far >= np.concatenate((far[1:], [0])))
        bad |= new
        w[new] = middle


def is_chance(n, count, k):
    """Whether a run of k equal readings is to be expected among n, of which ``count`` have that value."""
    share = np.maximum(count - k, 0) / np.maximum(1, n - k)
    return n * share ** (k - 1) > CHANCE


def _runs(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of at least RUN equal readings."""
    if len(u) < RUN:
        return np.empty(0, int), np.empty(0, int)
    start = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    length = np.diff(np.append(start, len(u)))
    return start[length >= RUN], length[length >= RUN]


def stuck(u: np.ndarray) -> np.ndarray:
    """Mask of runs of equal readings that are too long for chance at the series' own resolution."""
    out = np.zeros(len(u), bool)
    for s, k in zip(*_runs(u)):
        if not is_chance(len(u), int((u == u[s]).sum()), k):
            out[s : s + k] = True
    return out


def out_of_order(t: np.ndarray) -> np.ndarray:
    """Mask of the fewest readings whose removal leaves a series that never falls.

    A reading not below any before it and not above any after it is never removed; the stretches between
    such readings are solved one by one.
    """
    bad = np.zeros(len(t), bool)
    if len(t) < 2:
        return bad
    sure = (t >= np.maximum.accumulate(t)) & (t <= np.minimum.accumulate(t[::-1])[::-1])
    unsure = np.flatnonzero(~sure)
    if not len(unsure):
        return bad
    for part in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1):
        bad[part] = _fewest(t[part])
    return bad


def _fewest(t: np.ndarray) -> np.ndarray:
    tails, at, came = [], [], np.full(len(t), -1)
    for i, x in enumerate(t.tolist()):
        k = bisect_right(tails, x)
        came[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(x)
            at.append(i)
        else:
            tails[k] = x
            at[k] = i
    bad = np.ones(len(t), bool)
    i = at[-1]
    while i >= 0:
        bad[i] = False
        i = came[i]
    return bad


_KINDS = np.array(["", "spike", "impossible", "order"])
_FOUND = pa.schema(
    [("fault", pa.string()), ("field", pa.int32()), ("src", pa.string()), ("blk", pa.int64()), ("ids", pa.list_(pa.int64())), ("v", pa.float64()), ("n", pa.int64()), ("same", pa.int64()), ("k", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("crossing", pa.bool_())]
)


def _impossible(x: np.ndarray, rule: str, duration: float) -> np.ndarray:
    out = ~np.isfinite(x)
    if rule == "positive":
        out |= x <= 0
    elif rule == "time":
        out |= (x < 0) | (x >= duration if duration == duration else False)
    return out


def _judge(head: dict, t: pa.Table, i: int, rule: str, differences: bool):
    """Faults of one field in one block: ids by kind, and the runs of equal readings as rows of _FOUND."""
    v = np.asarray(t[f"v{i}"].to_numpy(), float)
    own = t["own"].to_numpy(zero_copy_only=False)
    known = np.flatnonzero(~np.isnan(v))
    code = np.zeros(len(known), np.int8)
    code[_impossible(v[known], rule, head["duration"])] = 2
    fine = np.flatnonzero(code == 0)
    at = known[fine]
    x = v[at]
    n = head[f"n{i}"]
    rows = []
    src, blk, rank, ids = head["src"], head["blk"], t["rank"].to_numpy(), t["id"].to_numpy()
    for s, k in zip(*_runs(x)):
        mine = at[s : s + k][own[at[s : s + k]]]
        if len(mine):
            # what crosses the border of a block, or may go on beyond what is seen
            crossing = bool(len(mine) < k or s == 0 and rank[0] > 0 or s + k == len(x))
            rows.append((i, src, blk, ids[mine].tolist(), float(x[s]), n, int(((x == x[s]) & own[at]).sum()), len(mine), int(rank[at[s]]), int(rank[at[s + k - 1]]), crossing))
    if rule == "time":
        code[fine[out_of_order(x)]] = 3
    elif n >= 8:
        code[fine[spikes(x, Bulk(n, head[f"q{i}"]), differences)]] = 1
    hit = known[(code > 0) & own[known]]
    kinds = code[(code > 0) & own[known]]
    return [(ids[hit[kinds == c]], c) for c in (1, 2, 3) if (kinds == c).any()], rows


def _scanner(fields: dict[str, str], differences: bool):
    def groups(batches):
        """One table per (src, blk) of the sorted stream."""
        held, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column("src").dictionary_encode().indices.to_numpy()
            blk = b.column("blk").to_numpy()
            cut = np.flatnonzero((code[1:] != code[:-1]) | (blk[1:] != blk[:-1])) + 1
            for a, z in zip(np.concatenate(([0], cut)), np.append(cut, b.num_rows)):
                now = (b.column("src")[int(a)].as_py(), int(blk[a]))
                if held and now != key:
                    yield pa.Table.from_batches(held)
                    held = []
                key = now
                held.append(b.slice(a, z - a))
        if held:
            yield pa.Table.from_batches(held)

    def scan(batches):
        for t in groups(batches):
            if t["n0"][0].as_py() is None:
                continue  # nothing but the readings beyond a source's last block
            head, t = t.slice(0, 1).to_pylist()[0], t.slice(1)
            out = {f.name: [] for f in _FOUND}
            for i, rule in enumerate(fields.values()):
                simple, runs = _judge(head, t, i, rule, differences)
                for ids, c in simple:
                    for name in out:
                        out[name].append({"fault": str(_KINDS[c]), "field": i, "ids": ids.tolist()}.get(name))
                for r in runs:
                    for name, x in zip(out, ("run", *r)):
                        out[name].append(x)
            if out["fault"]:
                yield pa.RecordBatch.from_pydict(out, schema=_FOUND)

    return scan


def _bulks(timed: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Per source: its last row number, duration, and number of usable readings and percentiles of every field, over all its rows."""
    aggs = []
    fractions = [*SHARES, 0.5, *(1 - x for x in SHARES)]
    for i, rule in enumerate(fields.values()):
        c = F.col(f"v{i}")
        usable = ~F.isnan(c) & (F.abs(c) < float("inf"))
        usable = usable & (c > 0) if rule == "positive" else usable & (c >= 0) & (F.isnan("duration") | (c < F.col("duration"))) if rule == "time" else usable
        aggs.append(F.count(F.when(usable, 1)).alias(f"n{i}"))
        aggs.append((F.lit(None).cast("array<double>") if rule == "time" else F.percentile_approx(F.when(usable, c), F.array(*map(F.lit, fractions)), ACCURACY)).alias(f"q{i}"))
    return timed.groupBy("src").agg(F.max("rank").alias("most"), F.max("duration").alias("duration"), *aggs)


def _stuck_runs(found: DataFrame, ranked: DataFrame, several: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(id, field) of all readings of runs too long for chance; runs are put together across blocks, values counted over the source."""
    runs = found.filter("fault = 'run'").select("field", "src", "blk", "ids", "v", "n", "same", "k", "first", "last", "crossing")
    # a block has at most two crossing runs per field, so a source's share of this window is its rows / BLOCK_ROWS
    w = Window.partitionBy("src", "field", "v").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    x = runs.filter("crossing").withColumn("new", F.coalesce((F.col("first") > F.max("last").over(w) + 1).cast("int"), F.lit(1)))
    x = x.withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("k", F.sum("k").over(Window.partitionBy("src", "field", "v", "no"))).drop("new", "no")
    runs = runs.filter("not crossing").unionByName(x)
    # a source of one block has counted its values already
    wide = ranked.join(several, "src", "left_semi").select("src", F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"v{i}").alias("v")) for i in range(len(fields))])).alias("x")).select("src", "x.*")
    counts = wide.join(runs.select("src", "field", "v").distinct(), ["src", "field", "v"], "left_semi").groupBy("src", "field", "v").agg(F.count(F.lit(1)).alias("all"))
    j = runs.join(counts, ["src", "field", "v"], "left").withColumn("same", F.coalesce("all", "same"))
    share = F.greatest(F.col("same") - F.col("k"), F.lit(0)) / F.greatest(F.col("n") - F.col("k"), F.lit(1))
    return j.filter(F.col("n") * F.pow(share, F.col("k") - 1) <= CHANCE).select(F.explode("ids").alias("id"), "field")


def measurement_faults(df: DataFrame, fields: dict[str, str], durations: DataFrame | None = None, *, source: str = "source", id: str = "id", block_rows: int = BLOCK_ROWS, halo: int = HALO, differences: bool = True) -> DataFrame:
    """Faulty readings per source.

    ``df`` has ``source`` (string), ``id`` (bigint, unique per reading and ascending in true order) and
    the double columns ``fields``, a map from name to rule: 'value' (any finite number may occur),
    'positive' (must be positive and finite) or 'time' (must lie in [0, duration) and never fall in the
    order of ``id``). ``durations``: (source, duration); without one only negative times are outside.
    Result: (id, field_name, fault) with fault 'spike', 'stuck', 'impossible' or 'order', one row per reading
    and field. Null and NaN readings are no cases and do not break a run. Repeated ids count once; rows with a
    null source or id are left out; a series of fewer than 8 readings has no spikes. An empty table gives no
    rows. Order is judged among ``block_rows`` readings and ``halo`` more on either side, all else over the source.
    ``differences`` off leaves the value as the ellipsoid's only axis, to measure what the differences add.
    """
    rows = df.select(F.col(source).cast("string").alias("src"), F.col(id).cast("long").alias("id"), *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"v{i}") for i, f in enumerate(fields)]).filter("src is not null and id is not null")
    ranked = number_rows(rows.withColumn("h", F.xxhash64("src")), "h", ["src", "id"], distinct=True).drop("h")
    if durations is not None:
        d = durations.select(F.col("source").cast("string").alias("src"), F.col("duration").cast("double").alias("duration")).groupBy("src").agg(F.max("duration").alias("duration"))
        timed = ranked.join(d, "src", "left").withColumn("duration", F.coalesce("duration", F.lit(float("nan"))))
    else:
        timed = ranked.withColumn("duration", F.lit(float("nan")))
    about = materialize(_bulks(timed, fields), "bulks")
    block = lambda shift: F.floor((F.col("rank") + shift) / block_rows).cast("long")
    cut = ranked.withColumn("home", block(0)).withColumn("blk", F.explode(F.array_distinct(F.array(block(0), block(-halo), block(halo))))).filter("blk >= 0").withColumn("own", F.col("blk") == F.col("home")).drop("home")
    # every block begins with a row of its source's figures
    heads = about.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("most") / block_rows).cast("long")))).withColumns({"rank": F.lit(-1).cast("long"), "own": F.lit(False)}).drop("most")
    figures = [c for c in heads.columns if c not in ("src", "blk", "rank", "own")]
    sorted_ = cut.unionByName(heads, allowMissingColumns=True).select("src", "blk", "rank", "id", "own", *[f"v{i}" for i in range(len(fields))], *figures).repartition("src", "blk").sortWithinPartitions("src", "blk", "rank")
    schema = "fault string, field int, src string, blk long, ids array<long>, v double, n long, same long, k long, first long, last long, crossing boolean"
    found = materialize(sorted_.mapInArrow(_scanner(dict(fields), differences), schema), "faults")
    simple = found.filter("fault != 'run'").select(F.explode("ids").alias("id"), "field", "fault")
    runs = _stuck_runs(found, ranked, about.filter(F.col("most") >= block_rows).select("src"), fields)
    both = simple.unionByName(runs.withColumn("fault", F.lit("stuck")))
    # of several faults of one reading the first in the alphabet that is not 'order' or 'spike' counts
    rank = F.when(F.col("fault") == "impossible", 0).when(F.col("fault") == "stuck", 1).otherwise(2)
    names = F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1)
    return both.groupBy("id", "field").agg(F.min_by("fault", rank).alias("fault")).select("id", names.alias("field_name"), "fault")
