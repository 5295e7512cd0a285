import numpy as np

from pulseframe.functions import spectra, spikefit


def test_known_parameters_are_recovered():
    f = np.linspace(1, 100, 199)
    y = 3 - np.log10(50 + f**2.0) + 0.8 * np.exp(-((f - 20) ** 2) / (2 * 2.0**2)) + 0.5 * np.exp(-((f - 60) ** 2) / (2 * 3.0**2))
    g = spectra.fit(f, 10**y, knee=True)
    assert abs(g["exponent"] - 2) < 0.15 and abs(g["knee"] / 50 - 1) < 0.5 and g["r2"] > 0.99
    assert [round(c) for c, *_ in g["peaks"][:2]] == [20, 60]
    plain = spectra.fit(f, 10 ** (1 - 1.5 * np.log10(f)))
    assert abs(plain["exponent"] - 1.5) < 1e-6 and abs(plain["offset"] - 1) < 1e-6


def test_bands():
    assert spectra.band_of(4.0) == "delta" and spectra.band_of(4.1) == "theta" and spectra.band_of(200) is None
    t = spectra.band_table([(13, 1.0, 2.0), (15, 3.0, 4.0), (50, 1.0, 1.0)])
    assert t == {"beta": (14.0, 2.0, 3.0, 2), "gamma": (50.0, 1.0, 1.0, 1)}


def test_simulated_trains_and_joined_polynomials():
    x = spikefit.simulate_train([np.array([0.0, 5, 1]), np.array([-2.0, 4, 0, np.nan])], [4, 3], tau=2.0, pad=(1, 2))
    assert len(x) == 3 + 4 + 3 + 3 + 3 and x[0] == 0 and x[7] == -2 and x[8] == -2
    knots = [0, 10, 20]
    sims = spikefit.simulate_piecewise_like(np.array([1.0, 0, 2, 50]), np.zeros((4, 4)), knots, [1, 1], 3, seed=1)
    assert len(sims) == 3 and np.allclose(sims[0], np.concatenate((np.arange(10.0), 10 + 2 * np.arange(10))))


def test_fitted_curves():
    x, at = spikefit.simulate_recording(1, 20_000, 5)
    from pulseframe.config import SpikeConfig

    w = x[at[2] - 200 : at[2] + 201]
    p, _ = spikefit.waveform_features(w, 20_000, SpikeConfig())
    c = spikefit.fitted_curves(w, 20_000, SpikeConfig())
    assert len(c["ramp"]) == p["inflection"] - p["ramp_start"] and np.abs(c["decay"] - w[p["exp_start"] : p["exp_end"]]).max() < 1
    assert spikefit.fitted_curves(np.zeros(401), 20_000, SpikeConfig()) is None
