import numpy as np
import pytest

from pulseframe.config import SpikeConfig
from pulseframe.functions import cluster1d, distributions, gaussian, models, signals, spikefit


def test_refractory_peaks():
    x = np.zeros(5000)
    x[[500, 540, 600, 680, 800, 1000]] = 10
    assert signals.find_peaks(x, 5, 50).tolist() == [540, 600, 680, 800, 1000]


def test_impulse_train_and_plateau():
    x = np.zeros(1000)
    x[100:1000:100] = 20
    assert signals.find_peaks(x, 1).tolist() == list(range(100, 1000, 100))
    assert signals.find_peaks(np.array([0, 3, 3, 3, 3, 0.0]), 1).tolist() == [2]
    assert signals.find_peaks(np.array([5, 1, 5.0]), 1).tolist() == []


def points_by_definition(w, peak, fs, c):
    """The control points, straight from their definition: sums for the lines, loops for the crossings."""
    ms = int(fs / 1000)
    slope = signals.lowess(np.diff(w), np.arange(1, len(w)) / fs, c.smooth_frac)
    steep = max(range(peak - ms, peak + ms), key=lambda i: (slope[i], -i))
    spread = slope[:steep].std()
    onset = next((i for i in range(steep - 1, -1, -1) if slope[i] <= spread), steep - 1)
    a = max(0, int(steep + c.pre_peak_ms[0] * ms))
    z = min(int(steep + c.pre_peak_ms[1] * ms), onset)

    def line(lo, hi):
        xs = list(range(lo, hi))
        if len(xs) == 1:
            return slope[lo] / (2 * lo), slope[lo] / 2
        mx, my = sum(xs) / len(xs), sum(slope[x] for x in xs) / len(xs)
        k = sum((x - mx) * (slope[x] - my) for x in xs) / sum((x - mx) ** 2 for x in xs)
        return k, my - k * mx

    (k0, c0), (k1, c1) = line(a, z), line(onset, steep)
    at = int((c0 - c1) / (k1 - k0))
    middle = (w[at] + w[peak]) / 2
    rise = next(i for i in range(peak - 1, -1, -1) if w[i] <= middle) + 1
    decay = next(i for i in range(peak, len(w)) if w[i] <= middle)
    return max(0, at - int(c.pre_inflection_ms * ms)), at, rise, decay


def test_control_points_of_simulated_spikes():
    c, n = SpikeConfig(), 0
    for seed in (5, 6):
        x, at = spikefit.simulate_recording(2, 20_000, seed)
        for i in at[(at > 200) & (at < len(x) - 201)]:
            w = x[i - 200 : i + 201]
            got = spikefit.waveform_features(w, 20_000, c)
            want = points_by_definition(w, 200, 20_000, c)
            assert got and tuple(got[0][k] for k in ("ramp_start", "inflection", "rise", "decay")) == want
            assert got[1]["inflection_time"] == (200 - want[1]) / 20 and 0 < got[1]["inflection_time"] < 5
            assert abs(got[1]["exp_lambda"] - 1) < 0.3 and abs(got[1]["exp_const"] + 65) < 2
            n += 1
    assert n >= 50


def test_flat_waveform_has_no_features():
    assert spikefit.waveform_features(np.zeros(401), 20_000, SpikeConfig()) is None


def test_piecewise_line():
    x = spikefit.simulate_piecewise([0, 50, 100], [np.array([1.0, 0.0]), np.array([1.0, 50.0])])
    assert np.allclose(x, np.arange(100))
    assert np.allclose(spikefit.piecewise_poly(x, [0, 50, 100], [1, 1])[1], [1, 50])
    for knots, degrees in (([0, 50, 40], [1, 1]), ([0, 50], [1, 1])):
        with pytest.raises(ValueError):
            spikefit.piecewise_poly(x, knots, degrees)


def test_filters():
    b = signals.butter_sections(4, [300, 3000], 20_000, "band")
    gain = lambda f: abs(np.prod([(s[0] + s[1] / z + s[2] / z**2) / (1 + s[4] / z + s[5] / z**2) for s in b for z in [np.exp(2j * np.pi * f / 20_000)]]))
    assert abs(gain(300) - 0.5**0.5) < 1e-6 and abs(gain(3000) - 0.5**0.5) < 1e-6 and gain(20) < 0.01
    assert np.allclose(signals.filter_both_ways(signals.butter_sections(2, 50, 1000, "low"), np.ones(100)), 1)
    with pytest.raises(ValueError):
        signals.butter_sections(2, 600, 1000, "low")


def test_spectra():
    t = np.arange(4000) / 1000
    x = np.sin(2 * np.pi * 20 * t)
    for f, p in (signals.welch_psd(x, 1000, 1000), signals.multitaper_psd(x, 1000)):
        assert abs(f[p.argmax()] - 20) < 0.5 and abs(p.sum() * f[1] - 0.5) < 0.02
    f = np.linspace(1, 100, 200)
    fit = signals.aperiodic_fit(f, 100 * f**-1.5, 2, 90)
    assert abs(fit["exponent"] - 1.5) < 1e-9 and abs(fit["offset"] - 2) < 1e-9


def test_changepoints_against_brute_force():
    x = np.concatenate((np.zeros(25), np.full(15, 4.0), np.full(20, 1.0))) + np.random.default_rng(2).normal(0, 0.3, 60)
    assert signals.changepoints(x) == [25, 40]
    assert signals.changepoints(np.zeros(100)) == []


def test_modes_and_kmeans():
    rng = np.random.default_rng(3)
    two = np.concatenate((rng.normal(0, 1, 300), rng.normal(10, 1, 300)))
    assert cluster1d.modes(two) == 2 and cluster1d.modes(rng.normal(0, 1, 600)) == 1
    labels = cluster1d.label_feature(np.append(two, np.nan))
    assert labels[-1] is None and set(labels[:300]) == {"low"} and set(labels[300:600]) == {"high"}
    assert cluster1d.kmeans(np.ones(9), 2) is None


def test_distributions():
    assert abs(distributions.t_two_sided(2.0, 10) - 0.0733880) < 1e-6
    assert abs(distributions.f_sf(3.0, 2, 20) - 0.0725382) < 1e-6
    assert abs(distributions.chi2_sf(5.991465, 2) - 0.05) < 1e-6
    assert abs(distributions.binom_greater(8, 10, 0.5) - 56 / 1024) < 1e-12
    assert abs(distributions.norm_two_sided(1.959964) - 0.05) < 1e-6


def test_ridge_and_sigmoid():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4))
    y = x @ np.array([1, 0, 0.5, 0]) + rng.normal(size=200)
    g = models.ridge_cv(x, y, permutations=30)
    assert g["r2"] > 0.4 and g["p"] < 0.05 and models.ridge_cv(x[:10], y[:10]) is None
    t = np.linspace(0, 10, 150)
    s = models.sigmoids(t, 1 / (1 + np.exp(-5 * (t - 4))))
    assert s["k"] == 1 and abs(s["centres"][0] - 4) < 0.01 and models.sigmoids(t, np.zeros(150)) is None


def test_gaussian_cycle():
    t = np.linspace(0, 1, 100)
    y = gaussian.cycle(t, [0.4, 0.1, -1, 10, 0.5, 0.1, 0, -30, 0.6, 0.1, 1, 20])
    assert gaussian.fit_cycle(y)[1] > 0.97
    assert len(gaussian.trough_cycles(np.tile(y, 5))) == 5
    with pytest.raises(ValueError):
        gaussian.cycle(t, [1, 2, 3])
