from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from pulseframe.functions import signals
from pulseframe.plans import models


def test_multitaper_reads_the_whole_series(spark, tmp_path):
    wave = lambda f, a, z: np.sin(2 * np.pi * f * np.arange(a, z))
    series = {1: np.concatenate((wave(0.05, 0, 64), 5 * wave(0.3, 64, 99))), 2: np.concatenate((wave(0.05, 0, 1_100), 9 * wave(0.3, 1_100, 1_300))), 3: wave(0.05, 0, 40)}
    rows = [(u, u * 10_000 + i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), "a", float(v)) for u, x in series.items() for i, v in enumerate(x)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["user_id", "event_id", "ts", "event_type", "value"])).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r for r in models.multitaper_psd(spark, str(tmp_path)).collect()}
    assert all(abs(got[u].peak_freq - f) < 0.04 for u, f in {1: 0.3, 2: 0.3, 3: 0.05}.items())


def test_multitaper_segments_hold_every_sample():
    x = np.random.default_rng(1).normal(0, 1, 1_300)
    base = signals.multitaper_psd(x, 1.0, longest=512)[1]
    assert len(base) == 257
    for i in (0, 600, 1_299):
        y = x.copy()
        y[i] += 50
        assert signals.multitaper_psd(y, 1.0, longest=512)[1].sum() > 1.2 * base.sum()


def test_recording_queries_read_all_chunks_of_the_table(spark, tmp_path):
    rest = [-65.0, -64.0] * 12
    bump = lambda x, at: [*x[:at], -50.0, *x[at + 1 :]]
    day = datetime(2024, 1, 1)
    rows = [("a", 0, bump(rest, 10), 96_000.0, day), ("a", 1, bump(rest, 23), 96_000.0, day), ("a", 2, rest, 96_000.0, day), ("a", 3, None, 96_000.0, day)]
    rows += [("a", 2, bump(rest, 12), 96_000.0, day + timedelta(days=9)), rows[1]]  # the late chunk replaces, the repeated one counts once
    rows += [("b", 0, bump(rest, 12), 24_000.0, day), ("c", 0, None, 1_000.0, day)]
    rows = [(r, 7, 50_000.0, k, k * 1_200_000, x, ms, day, at) for r, k, x, ms, at in rows]
    schema = "recording_id string, cell int, fs double, chunk_id int, sample_offset long, samples array<double>, duration_ms double, started_at timestamp, arrived_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/recordings.parquet")
    want = [("a", 10), ("a", 47), ("a", 60), ("b", 12)]
    f = models.waveform_features(spark, str(tmp_path)).orderBy("recording_id", "sample_idx").collect()
    assert [(r.recording_id, r.sample_idx) for r in f] == want
    assert [r.isi for r in f] == pytest.approx([37_000.0, 13_000.0, None, None])
    for q in (models.alt_python, models.piecewise_poly, models.gaussian_cycles):
        assert sorted((r.recording_id, r.sample_idx) for r in q(spark, str(tmp_path)).collect()) == want
