"""Cycles of extracellular spikes as sums of skewed Gaussians."""

from __future__ import annotations

from math import erf

import numpy as np

from .models import levenberg, r2

_erf = np.vectorize(erf, otypes=[float])


def gaussian(t: np.ndarray, centre: float, std: float, height: float) -> np.ndarray:
    return height * np.exp(-((t - centre) ** 2) / (2 * std**2))


def skewed(t: np.ndarray, centre: float, std: float, alpha: float, height: float) -> np.ndarray:
    """Gaussian times a normal distribution function, rescaled to its height."""
    z = (t - centre) / std
    y = np.exp(-(z**2) / 2) * (1 + _erf(alpha * z / np.sqrt(2)))
    top = np.abs(y).max()
    return height * y / top if top > 0 else y


def cycle(t: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Sum of skewed Gaussians; ``params`` holds centre, spread, skew and height of each."""
    p = np.asarray(params, float)
    if p.size % 4:
        raise ValueError("four parameters for each Gaussian")
    return sum(skewed(t, *q) for q in p.reshape(-1, 4))


def trough_cycles(x: np.ndarray, k: float = 1.5) -> list[dict[str, int]]:
    """Cycle points around troughs below mean - k std; of overlapping cycles the deeper stays."""
    x = np.asarray(x, float)
    low = np.flatnonzero((x[1:-1] < x[:-2]) & (x[1:-1] <= x[2:])) + 1
    high = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    deep = low[x[low] < x.mean() - k * x.std()]
    out: list[dict[str, int]] = []
    for t in deep:
        a, b = high[high < t], high[high > t]
        if not len(a) or not len(b):
            continue
        last, nxt = int(a[-1]), int(b[0])
        start = low[low < last]
        end = low[low > nxt]
        c = {"start": int(start[-1]) if len(start) else 0, "last_peak": last, "trough": int(t), "next_peak": nxt, "end": int(end[0]) if len(end) else len(x) - 1}
        c["decay"], c["rise"] = round((last + int(t)) / 2), round((int(t) + nxt) / 2)
        if out and out[-1]["next_peak"] > c["last_peak"]:
            if x[t] < x[out[-1]["trough"]]:
                out[-1] = c
            continue
        out.append(c)
    return out


def shape(x: np.ndarray, c: dict[str, int]) -> dict[str, float]:
    """Durations, voltages and symmetry of a cycle."""
    d, r = c["trough"] - c["last_peak"], c["next_peak"] - c["trough"]
    return {
        "period": c["end"] - c["start"] + 1,
        "time_trough": c["rise"] - c["decay"],
        "time_decay": d,
        "time_rise": r,
        "time_decay_sym": d / (d + r),
        "time_rise_sym": r / (d + r),
        **{f"volt_{k}": float(x[c[k]]) for k in ("trough", "last_peak", "next_peak", "decay", "rise")},
    }


def fit_cycle(y: np.ndarray, n: int = 3) -> tuple[np.ndarray, float]:
    """n skewed Gaussians fitted to a demeaned cycle: (parameters padded with NaN to 12, R2)."""
    y = np.asarray(y, float) - np.mean(y)
    t = np.linspace(0, 1, len(y))
    k = int(np.argmin(y))
    before = int(np.argmax(y[: k + 1])) if k else 0
    after = k + int(np.argmax(y[k:]))
    spots = {1: [k], 2: [k, after], 3: [before, k, after]}[n]
    start = np.array([v for s in spots for v in (t[s], 0.08, 0.0, y[s])])
    top = np.abs(y).max() or 1.0
    lo = np.array([v for s in spots for v in (max(0, t[s] - 0.3), 0.01, -5.0, -2 * top)])
    hi = np.array([v for s in spots for v in (min(1, t[s] + 0.3), 0.5, 5.0, 2 * top)])
    p, _ = levenberg(lambda q: cycle(t, q) - y, start, lo, hi)
    return np.concatenate((p, np.full(12 - len(p), np.nan))), r2(y, cycle(t, p))
