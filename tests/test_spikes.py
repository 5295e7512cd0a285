import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.config import SpikeConfig
from pulseframe.functions import spikefit
from pulseframe.operators import spikes
from pulseframe.sources import tables
from pulseframe.sources.binary import RecordingSource, parse_name


@pytest.fixture(scope="module")
def signal():
    return spikefit.simulate_recording(1.0, 20_000, 9)


def test_chunks_do_not_change_the_events(spark, signal):
    x, at = signal
    whole = spikes.detect(spikes.write_recording(spark, "r", x, 20_000, len(x)))
    cut = spikes.detect(spikes.write_recording(spark, "r", x, 20_000, 1_500))
    a, b = ({(r.sample_idx, round(sum(r.wf), 6)) for r in d.collect()} for d in (whole, cut))
    assert a == b
    assert {i for i, _ in a} == {int(i) for i in at if 200 <= i < len(x) - 201}


def test_repeated_and_null_chunks(spark, signal):
    x, _ = signal
    c = spikes.write_recording(spark, "r", x, 20_000, 5_000)
    assert spikes.detect(c.unionByName(c)).count() == spikes.detect(c).count()
    hole = c.withColumn("samples", F.when(F.col("chunk_id") == 1, F.lit(None)).otherwise(F.col("samples")))
    assert 0 < spikes.detect(hole).count() < spikes.detect(c).count()
    assert spikes.fit(c.limit(0)).count() == 0


def test_fit_filter_process_alt(spark, signal):
    x, at = signal
    c = spikes.write_recording(spark, "r", x, 20_000, 4_000)
    f = spikes.fit(c)
    rows = f.orderBy("t_us").collect()
    assert rows[-1].isi is None and rows[0].isi_prev is None
    assert np.allclose([r.isi for r in rows[:-1]], np.diff([r.sample_idx for r in rows]) / 20, atol=0.001)
    assert spikes.quality_filter(f).count() <= f.count()
    p = spikes.process(f)
    assert "isi" not in p.columns and "log_isi" in p.columns
    a = spikes.alt(spikes.detect(c), lambda w, fs: w.max(), ["top"]).collect()
    assert all(r.top > 10 for r in a)
    bad = spikes.alt(spikes.detect(c), lambda w, fs: 1 / 0, ["top"]).collect()
    assert all(r.top is None for r in bad)


def test_flip(spark, signal):
    x, _ = signal
    c = spikes.write_recording(spark, "r", -x, 20_000, 4_000)
    assert spikes.detect(c, SpikeConfig(flip=True)).count() == spikes.detect(spikes.write_recording(spark, "r", x, 20_000, 4_000)).count()


def test_binary_source(spark, tmp_path):
    assert parse_name("/x/c21_patch.bin") == (21, "patch") and parse_name("notes.txt") is None
    x = np.arange(1000, dtype="<f8")
    x.tofile(tmp_path / "c21_patch.bin")
    (np.arange(400, dtype="<i2").reshape(-1, 4)).tofile(tmp_path / "c22_lfp.bin")
    (tmp_path / "readme.txt").write_text("no recording")
    spark.dataSource.register(RecordingSource)
    df = spark.read.format("recording").option("chunk", 300).option("channels", 4).option("channel", 2).option("chunksPerTask", 2).load(str(tmp_path))
    got = {}
    for r in df.orderBy("recording_id", "chunk_id").collect():
        got.setdefault(r.cell, []).extend(r.samples)
    assert got == {21: x.tolist(), 22: list(range(2, 400, 4))}
    assert spark.read.format("recording").option("cells", "99").load(str(tmp_path)).count() == 0


def test_tables(spark, tmp_path):
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(2)
    u = tables.union_tables([a, b], "src")
    assert u.count() == 5 and u.filter("x is null").count() == 2
    calls = []
    path = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert tables.load_or_compute(spark, path, lambda: calls.append(1) or a).count() == 3
    assert calls == [1]
    for n in (0, 1):
        a.write.parquet(f"file://{tmp_path}/feat_{n}")
    assert sorted(r.chunk_no for r in tables.load_chunked(spark, f"file://{tmp_path}", "feat").select("chunk_no").distinct().collect()) == [0, 1]


def test_windows_unlike_the_others_are_dropped(spark):
    rng = np.random.default_rng(3)
    base = np.sin(np.arange(40) / 5)
    wf = [base + rng.normal(0, 0.1, 40) for _ in range(12)] + [-base, rng.normal(0, 1, 40), np.zeros(40)]
    df = spark.createDataFrame([("r", i, [float(v) for v in w]) for i, w in enumerate(wf)] + [("alone", 99, [1.0, 2.0])], "recording_id string, sample_idx long, wf array<double>")
    got = sorted(r.sample_idx for r in spikes.correlated(df, 0.5).collect())
    c = np.corrcoef(np.array(wf[:14]))
    assert got == np.flatnonzero((c.sum(0) - 1) / 13 > 0.5).tolist() == list(range(12))


def test_a_second_signal_at_another_rate(spark):
    x = np.arange(3000.0)
    second = spikes.write_recording(spark, "r", x, 500.0, 700)
    ev = spark.createDataFrame([("r", 1000.0, 5, 40), ("r", 1000.0, 6, 2803), ("r", 1000.0, 7, 5990), ("r", 1000.0, 8, None)], "recording_id string, fs double, sample_idx long, rise long")
    w = spikes.other_signal(ev, second, "rise", (20.0, 30.0))
    assert {r.sample_idx: (r.wf[0], r.wf[-1], len(r.wf)) for r in w.collect()} == {5: (10.0, 35.0, 26), 6: (1391.0, 1416.0, 26)}
    out = spikes.alt(w, lambda v, fs: v.mean() if fs == 500 and v[0] > 100 else 1 / 0, ["m"], errors=True)
    assert {r.sample_idx: (r.m, r.alt_error) for r in out.collect()} == {5: (None, "ZeroDivisionError: division by zero"), 6: (1403.5, None)}
