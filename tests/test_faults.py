import numpy as np

from pulseframe.operators.faults import measurement_faults, out_of_order, spikes, stuck

FIELDS = {"amp": "value", "width": "positive", "t": "time"}


def test_spikes_between_states_are_none():
    rng = np.random.default_rng(1)
    u = np.where(rng.random(500) < 0.3, 10.0, 20.0) + rng.normal(0, 0.3, 500)
    assert not spikes(u).any()
    u[[50, 51, 400]] = (90.0, 95.0, -70.0)
    assert np.flatnonzero(spikes(u)).tolist() == [50, 51, 400]


def test_spikes_of_short_and_constant_series():
    assert not spikes(np.array([1.0, 2, 900])).any()
    assert not spikes(np.full(50, 3.0)).any()


def test_stuck_depends_on_resolution():
    rng = np.random.default_rng(2)
    fine = rng.normal(0, 1, 300)
    fine[100:106] = fine[100]
    assert np.flatnonzero(stuck(fine)).tolist() == list(range(100, 106))
    assert not stuck(np.round(rng.normal(0, 0.4, 300))).any()


def test_order_removes_the_fewest():
    assert np.flatnonzero(out_of_order(np.array([1.0, 2, 90, 3, 3, 4, -5, 6]))).tolist() == [2, 6]


def make(n=600, seed=3):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 10_000, n))
    amp, width = rng.normal(20, 1, n), rng.normal(1, 0.05, n)
    amp[10], width[20], width[21], t[30], t[40] = 400.0, -1.0, np.inf, 99_999.0, t[300]
    amp[100:108] = amp[100]
    amp[200] = np.nan
    want = {(10, "amp"), (20, "width"), (21, "width"), (30, "t"), (40, "t"), *((i, "amp") for i in range(100, 108))}
    return t, amp, width, want


def test_faults_per_source_and_in_blocks(spark):
    t, amp, width, want = make()
    rows = [("s", i, float(amp[i]), float(width[i]), float(t[i])) for i in range(len(t))]
    rows += [rows[10], rows[100], (None, 5, 1.0, 1.0, 1.0), ("s", None, 1.0, 1.0, 1.0), ("empty", 9_999, None, None, None)]
    df = spark.createDataFrame(rows, "source string, id long, amp double, width double, t double")
    df = df.selectExpr("*", "1 as g", "2 as blk", "3 as own", "4 as n")
    d = spark.createDataFrame([("s", 10_000.0), ("s", None)], "source string, duration double")
    for block, halo in ((50_000, 2_500), (250, 40)):
        got = measurement_faults(df, FIELDS, d, block_rows=block, halo=halo).collect()
        assert {(r.id, r.field_name) for r in got} == want
        assert len(got) == len(want)


def test_the_differences_decide():
    """A reading at a moderate distance is a spike for its jump; without the differences it is none, and a drift never is."""
    rng = np.random.default_rng(5)
    u = rng.normal(0, 0.3, 400)
    u[200] = 1.75 * np.subtract(*np.quantile(u, (0.96, 0.04)))
    assert np.flatnonzero(spikes(u)).tolist() == [200]
    assert not spikes(u, differences=False).any()
    slow = np.concatenate((u[:150] * 0.1, np.linspace(0, 1, 100) * u[200], np.full(150, u[200])))
    assert not spikes(slow).any()


def test_bulk_and_runs_are_those_of_the_whole_source(spark):
    """A state that fills one block only is normal, and a run over several blocks is one run."""
    rng = np.random.default_rng(6)
    v = np.concatenate((rng.normal(10, 0.3, 900), rng.normal(30, 0.3, 100)))
    v[950] = 200.0
    v[300:700] = v[300]
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "source string, id long, amp double")
    got = {(r.id, r.fault) for r in measurement_faults(df, {"amp": "value"}, block_rows=100, halo=10).collect()}
    assert got == {(950, "spike"), *((i, "stuck") for i in range(300, 700))}


def test_order_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(40):
        t = np.sort(rng.integers(0, 60, 40)).astype(float)
        t[rng.integers(0, 40, 5)] = rng.integers(0, 60, 5)
        best = [1] * 40
        for i in range(40):
            best[i] += max((best[j] for j in range(i) if t[j] <= t[i]), default=0)
        bad = out_of_order(t)
        assert (np.diff(t[~bad]) >= 0).all() and (~bad).sum() == max(best)


def test_faults_empty(spark):
    df = spark.createDataFrame([], "source string, id long, amp double, width double, t double")
    assert measurement_faults(df, FIELDS).count() == 0
