"""Features of one waveform: control points, ramp, peak and decay."""

from __future__ import annotations

import warnings

import numpy as np

from ..config import SpikeConfig
from .signals import lowess

#: Bounds and first guess of the decay A exp(-lambda t) + C, fixed values: amplitude, rate, constant.
EXP_LOW, EXP_HIGH, EXP_START = (0.0, 0.0, -100.0), (1000.0, 10.0, 50.0), (50.0, 1.0, -60.0)
POINTS = ("ramp_start", "inflection", "rise", "peak", "decay", "exp_start", "exp_end")
FEATURES = ("ramp_amp", "inflection_time", "inflection_amp", "peak_amp", "peak_width", "peak_sharpness", "exp_lambda", "exp_const", "r2_ramp", "r2_exp")


def _r2(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 2 or a.std() == 0 or b.std() == 0:
        return np.nan
    return float(np.corrcoef(a, b)[0, 1] ** 2)


def _line(y: np.ndarray, first: int) -> tuple[float, float]:
    """Slope and intercept over sample numbers that start at ``first``."""
    x = np.arange(first, first + len(y))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # a single sample leaves the line to the smallest coefficients
        slope, intercept = np.polyfit(x, y, 1)
    return float(slope), float(intercept)


def control_points(w: np.ndarray, peak: int, fs: float, c: SpikeConfig) -> dict[str, int]:
    """The seven control points of a waveform; ValueError where one does not exist."""
    ms = int(fs / 1000)
    slope = lowess(np.diff(w), np.arange(1, len(w)) / fs, c.smooth_frac)
    lo, hi = max(0, peak - ms), min(len(slope), peak + ms)
    steep = lo + int(np.argmax(slope[lo:hi]))
    quiet = np.flatnonzero(slope[:steep] <= slope[:steep].std()) if steep > 1 else np.empty(0, int)
    onset = int(quiet[-1]) if len(quiet) else steep - 1
    a = max(0, int(steep + c.pre_peak_ms[0] * ms))
    z = min(max(a, int(steep + c.pre_peak_ms[1] * ms)), onset)
    if z <= a or steep <= onset:
        raise ValueError("no ramp before the upstroke")
    # both lines lie in the smoothed derivative: before the upstroke, and from its onset up to, not including, the steepest sample
    base, rise_line = _line(slope[a:z], a), _line(slope[onset:steep], onset)
    if rise_line[0] == base[0]:
        raise ValueError("ramp and upstroke are parallel")
    inflection = int((base[1] - rise_line[1]) / (rise_line[0] - base[0]))
    if not 0 < inflection < peak:
        raise ValueError("inflection outside of the rise")
    middle = (w[inflection] + w[peak]) / 2
    below_left = np.flatnonzero(w[:peak] <= middle)
    below_right = np.flatnonzero(w[peak:] <= middle)
    if not len(below_left) or not len(below_right):
        raise ValueError("half height is not crossed")
    start = peak + int(ms / c.exp_shift_divisor)
    end = start + int(ms * c.exp_duration_ms)
    points = (max(0, inflection - int(c.pre_inflection_ms * ms)), inflection, int(below_left[-1]) + 1, peak, peak + int(below_right[0]), start, end if end <= len(w) else len(w) - 1)
    return dict(zip(POINTS, points))


def fit_exponential(y: np.ndarray, dt_ms: float) -> tuple[float, float, float]:
    """Bounded (A, lambda, C) of A exp(-lambda t) + C: for each rate the other two are linear, so one search suffices."""
    t = np.arange(len(y)) * dt_ms

    def solve(rate):
        e = np.exp(-rate * t)
        spread = ((e - e.mean()) ** 2).sum()
        amp = float(np.clip(((e - e.mean()) * (y - y.mean())).sum() / spread if spread > 1e-15 else 0.0, EXP_LOW[0], EXP_HIGH[0]))
        const = float(np.clip(y.mean() - amp * e.mean(), EXP_LOW[2], EXP_HIGH[2]))
        return float(((amp * e + const - y) ** 2).sum()), amp, const

    grid = np.linspace(EXP_LOW[1], EXP_HIGH[1], 81)
    k = int(np.argmin([solve(r)[0] for r in grid]))
    lo, hi = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    golden = (np.sqrt(5) - 1) / 2
    a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
    fa, fb = solve(a)[0], solve(b)[0]
    for _ in range(60):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - golden * (hi - lo)
            fa = solve(a)[0]
        else:
            lo, a, fa = a, b, fb
            b = lo + golden * (hi - lo)
            fb = solve(b)[0]
    rate = (lo + hi) / 2
    _, amp, const = solve(rate)
    return amp, float(rate), const


def waveform_features(w: np.ndarray, fs: float, c: SpikeConfig, peak: int | None = None) -> tuple[dict[str, int], dict[str, float]] | None:
    """Control points (relative to the window) and features; None where the waveform has no such shape."""
    w = np.asarray(w, float)
    peak = c.samples(fs)[0] if peak is None else peak
    ms = int(fs / 1000)
    try:
        p = control_points(w, peak, fs, c)
        ramp = w[p["ramp_start"] : p["inflection"]]
        x = np.arange(len(ramp)) * (1000 / fs)
        poly = np.polyfit(x, ramp, c.poly_order)
        tail = w[p["exp_start"] : p["exp_end"]]
        amp, rate, const = fit_exponential(tail, 1000 / fs)
        near = max(1, int(fs / 1000 / 10))
        f = {
            "ramp_amp": float(poly[0]),
            "inflection_time": (peak - p["inflection"]) / ms,
            "inflection_amp": float(ramp[-1]),
            "peak_amp": float(w[peak]),
            "peak_width": (p["decay"] - p["rise"]) / ms,
            "peak_sharpness": float(((w[peak] - w[peak - near]) + (w[peak] - w[peak + near])) / 2),
            "exp_lambda": rate,
            "exp_const": const,
            "r2_ramp": _r2(ramp, np.polyval(poly, x)),
            "r2_exp": _r2(tail, amp * np.exp(-rate * np.arange(len(tail)) * 1000 / fs) + const),
        }
    except (ValueError, IndexError, np.linalg.LinAlgError):
        return None
    return p, f


def piecewise_poly(w: np.ndarray, knots: list[int], degrees: list[int], pad: int = 2, weight: float = 10.0) -> list[np.ndarray]:
    """Polynomials between ascending knots, samples near a knot weighing more; coefficients highest power first."""
    if len(degrees) != len(knots) - 1:
        raise ValueError("one degree for each stretch between knots")
    if any(b <= a for a, b in zip(knots, knots[1:])):
        raise ValueError("knots must ascend")
    out = []
    for a, b, k in zip(knots, knots[1:], degrees):
        x = np.arange(b - a, dtype=float)
        weights = np.ones(len(x))
        weights[:pad] = weights[-pad:] = weight
        out.append(np.polyfit(x, np.asarray(w[a:b], float), min(k, max(0, len(x) - 1)), w=weights))
    return out


def simulate_piecewise(knots: list[int], coefficients: list[np.ndarray]) -> np.ndarray:
    """Signal of polynomials between ascending knots."""
    if any(b <= a for a, b in zip(knots, knots[1:])):
        raise ValueError("knots must ascend")
    return np.concatenate([np.polyval(c, np.arange(b - a, dtype=float)) for a, b, c in zip(knots, knots[1:], coefficients)])


def fitted_curves(w: np.ndarray, fs: float, c: SpikeConfig, peak: int | None = None) -> dict[str, np.ndarray] | None:
    """Fitted ramp (from its start up to the inflection) and fitted decay of a waveform, in its own units."""
    got = waveform_features(w, fs, c, peak)
    if got is None:
        return None
    p, f = got
    w = np.asarray(w, float)
    ramp = w[p["ramp_start"] : p["inflection"]]
    x = np.arange(len(ramp)) * (1000 / fs)
    tail = w[p["exp_start"] : p["exp_end"]]
    amp, rate, const = fit_exponential(tail, 1000 / fs)
    return {"ramp": np.polyval(np.polyfit(x, ramp, c.poly_order), x), "decay": amp * np.exp(-rate * np.arange(len(tail)) * 1000 / fs) + const}


def continuous(knots: list[int], coefficients: list[np.ndarray]) -> list[np.ndarray]:
    """The same polynomials with constants shifted so that each stretch begins where the one before it ends."""
    out = [np.array(coefficients[0], float)]
    for k in range(1, len(coefficients)):
        c = np.array(coefficients[k], float)
        c[-1] = np.polyval(out[-1], knots[k] - knots[k - 1])
        out.append(c)
    return out


def simulate_piecewise_like(mean: np.ndarray, covariance: np.ndarray, knots: list[int], degrees: list[int], n: int, seed: int) -> list[np.ndarray]:
    """``n`` joined signals whose coefficients are drawn from a normal distribution, as fitted over many waveforms."""
    draws = np.random.default_rng(seed).multivariate_normal(mean, covariance, n)
    cuts = np.cumsum([d + 1 for d in degrees])[:-1]
    return [simulate_piecewise(knots, continuous(knots, np.split(row, cuts))) for row in draws]


def simulate_train(spikes: list[np.ndarray], gaps: list[int], tau: float, pad: tuple[int, int] | None = None) -> np.ndarray:
    """Waveforms one after the other, each followed by an exponential approach to the next one's first value.

    A gap of 0 samples joins two waveforms directly; the last gap leads back to the last waveform's own start.
    """
    shapes = [np.asarray(s, float)[~np.isnan(s)] for s in spikes]
    parts = []
    for i, (s, gap) in enumerate(zip(shapes, gaps)):
        parts.append(s)
        if gap > 0:
            end = shapes[i + 1][0] if i + 1 < len(shapes) else s[0]
            rise = 1 - np.exp(-np.arange(gap) / tau)
            rise = rise / rise[-1] if gap > 1 else np.ones(1)
            parts.append(end + abs(end - s[-1]) * (rise - 1))
    x = np.concatenate(parts)
    return np.pad(x, pad, constant_values=(x[0], x[-1])) if pad else x


def simulate_recording(seconds: float, fs: float, seed: int, mean_isi_ms: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    """A made-up intracellular recording and the samples of its peaks: ramp, upstroke, exponential decay."""
    rng = np.random.default_rng(seed)
    n = int(seconds * fs)
    ms = fs / 1000
    x = np.full(n, -65.0) + rng.normal(0, 0.02, n)
    at, t = [], int(15 * ms)
    while t < n - 15 * ms:
        top = rng.normal(30, 2)
        r, u = int(2 * ms), int(0.5 * ms)
        x[t - u - r : t - u] += np.linspace(0, 10, r)
        x[t - u : t] = np.linspace(-55, top, u, endpoint=False)
        tail = np.arange(int(12 * ms))
        x[t : t + len(tail)] = (top + 65) * np.exp(-tail / ms * rng.normal(1.0, 0.05)) - 65 + rng.normal(0, 0.02, len(tail))
        at.append(t)
        t += int((15 + rng.exponential(mean_isi_ms)) * ms)
    return x, np.array(at)
