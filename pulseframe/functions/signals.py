"""Kernels over one signal: peak detection, smoothing, filters, spectra, change points."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def find_peaks(x: np.ndarray, height: float, distance: int = 1) -> np.ndarray:
    """Strict local maxima of at least ``height``; of peaks closer than ``distance`` the highest stays.

    A plateau counts once, in its middle (rounded down); of equal heights the later peak goes first.
    """
    x = np.asarray(x, float)
    n = len(x)
    if n < 3:
        return np.empty(0, int)
    change = np.flatnonzero(np.diff(x) != 0)
    left = np.concatenate(([0], change + 1))
    right = np.concatenate((change, [n - 1]))
    level = x[left]
    top = np.zeros(len(left), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    peaks = (left[top] + right[top]) // 2
    peaks = peaks[x[peaks] >= height]
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[i]:
            lo, hi = np.searchsorted(peaks, (peaks[i] - distance + 1, peaks[i] + distance))
            keep[lo:hi] = False
            keep[i] = True
    return peaks[keep]


def recentre(x: np.ndarray, at: np.ndarray, pad: int) -> np.ndarray:
    """Each index moved to the first maximum within pad//2 on either side; each result once."""
    half, out = pad // 2, []
    for i in at:
        lo, hi = max(0, i - half), min(len(x), i + half)
        out.append(lo + int(np.argmax(x[lo:hi])) if hi > lo else int(i))
    return np.array(list(dict.fromkeys(out)), int)


def lowess(y: np.ndarray, x: np.ndarray, frac: float, rounds: int = 3) -> np.ndarray:
    """Locally weighted linear regression with tricube weights and bisquare reweighting."""
    n = len(y)
    k = min(n, max(2, int(frac * n + 1e-10)))
    lo = np.zeros(n, int)
    at = 0
    for i in range(n):
        while at + k < n and x[at + k] - x[i] < x[i] - x[at]:
            at += 1
        lo[i] = at
    index = lo[:, None] + np.arange(k)
    xs, ys = x[index], y[index]
    away = np.abs(xs - x[:, None])
    reach = away.max(1, keepdims=True)
    reach[reach == 0] = 1
    base = (1 - np.clip(away / reach, 0, 1) ** 3) ** 3
    base[away > 0.999 * reach] = 0
    base[away <= 0.001 * reach] = 1
    robust = np.ones(n)
    fit = y.astype(float)
    for step in range(rounds + 1):
        w = base * robust[index]
        total = w.sum(1)
        ok = total > 0
        w = w / np.where(ok, total, 1)[:, None]
        mx, my = (w * xs).sum(1), (w * ys).sum(1)
        sxx = (w * (xs - mx[:, None]) ** 2).sum(1)
        sxy = (w * (xs - mx[:, None]) * (ys - my[:, None])).sum(1)
        slope = np.where(sxx > 1e-12 * (x[-1] - x[0]) ** 2, sxy / np.where(sxx == 0, 1, sxx), 0)
        fit = np.where(ok, my + slope * (x - mx), y)
        if step == rounds:
            break
        rest = np.abs(y - fit)
        s = np.median(rest)
        if s == 0:
            break
        u = rest / (6 * s)
        robust = np.where(u < 1, (1 - u**2) ** 2, 0)
    return fit


def butter_sections(order: int, cutoff, fs: float, kind: str) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a Butterworth filter: 'low', 'high' or 'band'."""
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if (edges <= 0).any() or (edges >= fs / 2).any() or (np.diff(edges) <= 0).any():
        raise ValueError("cutoffs must ascend between 0 and half the sampling rate")
    warped = 2 * fs * np.tan(np.pi * edges / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "low":
        p, z, gain = poles * warped[0], np.empty(0), warped[0] ** order
    elif kind == "high":
        p, z, gain = warped[0] / poles, np.zeros(order), 1.0
    else:
        width, middle = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - middle**2)
        p, z, gain = np.concatenate((half + root, half - root)), np.zeros(order), width**order
    k = gain * np.real(np.prod(2 * fs - z) / np.prod(2 * fs - p))
    zd = np.concatenate(((2 * fs + z) / (2 * fs - z), -np.ones(len(p) - len(z))))
    pd = (2 * fs + p) / (2 * fs - p)
    upper = sorted(pd[pd.imag > 1e-12], key=abs)
    real = sorted(pd[np.abs(pd.imag) <= 1e-12].real)
    pairs = [(q, np.conj(q)) for q in upper] + [(real[i], real[i + 1] if i + 1 < len(real) else 0.0) for i in range(0, len(real), 2)]
    zs = sorted(zd.real)
    out = []
    for i, (a, b) in enumerate(pairs):
        z0, z1 = (zs[i], zs[-1 - i]) if 2 * len(pairs) == len(zs) else (zs[i] if i < len(zs) else 0.0, zs[-1 - i] if len(zs) - 1 - i > i else 0.0)
        out.append([1.0, -(z0 + z1), z0 * z1, 1.0, float(np.real(-(a + b))), float(np.real(a * b))])
    sections = np.array(out)
    sections[0, :3] *= k
    return sections


def _run(sections: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    y = x.astype(float).tolist()
    for (b0, b1, b2, _, a1, a2), (s0, s1) in zip(sections.tolist(), state.tolist()):
        for i, v in enumerate(y):
            o = b0 * v + s0
            s0 = b1 * v - a1 * o + s1
            s1 = b2 * v - a2 * o
            y[i] = o
    return np.array(y)


def _steady(sections: np.ndarray) -> np.ndarray:
    """States that a constant input of 1 leaves unchanged."""
    out, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        g = (b0 + b1 + b2) / (1 + a1 + a2)
        out.append([(g - b0) * level, (b2 - a2 * g) * level])
        level *= g
    return np.array(out)


def filter_both_ways(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering with odd extension at both ends."""
    pad = min(len(x) - 1, 3 * (2 * len(sections) + 1))
    ext = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1])) if pad > 0 else np.asarray(x, float)
    still = _steady(sections)
    y = _run(sections, ext, still * ext[0])
    y = _run(sections, y[::-1], still * y[-1])[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


def welch_psd(x: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """Power density: Hann windows, half overlap, each segment's mean removed."""
    x = np.asarray(x, float)
    n = min(nperseg, len(x))
    step = max(1, n - n // 2)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    at = np.arange(0, len(x) - n + 1, step)
    seg = x[at[:, None] + np.arange(n)]
    seg = (seg - seg.mean(1, keepdims=True)) * win
    p = (np.abs(np.fft.rfft(seg, axis=1)) ** 2).mean(0) / (fs * (win**2).sum())
    p[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


@lru_cache(256)
def slepian(n: int, nw: float, k: int) -> np.ndarray:
    """The first k discrete prolate spheroidal sequences, of unit energy."""
    i = np.arange(n)
    main = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * nw / n)
    side = i[1:] * (n - i[1:]) / 2
    _, v = np.linalg.eigh(np.diag(main) + np.diag(side, 1) + np.diag(side, -1))
    tapers = v[:, ::-1][:, :k].T
    for j, t in enumerate(tapers):
        lead = t.sum() if j % 2 == 0 else (t * (n - 1 - 2 * i)).sum()
        if lead < 0:
            tapers[j] = -t
    return tapers


def multitaper_psd(x: np.ndarray, fs: float, nw: float = 2.5, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Power density averaged over 2NW-1 tapers; the mean is removed first.

    A series of more than ``longest`` samples is cut into segments of that length, evenly placed from its
    first to its last sample so that every sample enters, and their densities are averaged.
    """
    x = np.asarray(x, float) - np.mean(x)
    n = min(len(x), longest or len(x))
    at = np.linspace(0, len(x) - n, -(-len(x) // n)).astype(int)
    t = slepian(n, nw, max(1, int(2 * nw - 1)))
    p = sum((np.abs(np.fft.rfft(t * x[a : a + n], axis=1)) ** 2).mean(0) for a in at) / (len(at) * fs)
    p[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def aperiodic_fit(freqs: np.ndarray, power: np.ndarray, lo: float, hi: float) -> dict:
    """Offset and exponent of a line in log-log space, robust against peaks: a second fit over the lower residuals."""
    ok = (freqs >= lo) & (freqs <= hi) & (power > 0) & (freqs > 0)
    f, p = np.log10(freqs[ok]), np.log10(power[ok])
    if len(f) < 4 or np.ptp(f) == 0:
        return {"offset": None, "exponent": None, "r2": None}
    line = np.polyfit(f, p, 1)
    rest = p - np.polyval(line, f)
    low = rest <= np.quantile(np.clip(rest, 0, None), 0.75)
    if low.sum() >= 4 and np.ptp(f[low]) > 0:
        line = np.polyfit(f[low], p[low], 1)
    fit = np.polyval(line, f)
    r = np.corrcoef(p, fit)[0, 1] if p.std() > 0 and fit.std() > 0 else np.nan
    return {"offset": float(line[1]), "exponent": float(-line[0]), "r2": float(r * r) if r == r else None}


def band_area(freqs: np.ndarray, power: np.ndarray, fit: dict, lo: float, hi: float, clip: bool = False) -> float | None:
    """Trapezoid area between log power and the aperiodic line in a band; optionally not below zero."""
    ok = (freqs >= lo) & (freqs <= hi) & (freqs > 0) & (power > 0)
    if ok.sum() < 2 or fit["offset"] is None:
        return None
    over = np.log10(power[ok]) - (fit["offset"] - fit["exponent"] * np.log10(freqs[ok]))
    over = np.clip(over, 0, None) if clip else over
    f = freqs[ok]
    return float(((over[1:] + over[:-1]) / 2 * np.diff(f)).sum())


def peakiness(freqs: np.ndarray, power: np.ndarray, mains: float = 50.0, width: float = 2.0) -> dict:
    """Strongest peak of log power over the aperiodic line, away from mains harmonics, with its half-height width."""
    fit = aperiodic_fit(freqs, power, max(freqs[1], 1e-9), freqs[-1])
    ok = (freqs > 0) & (power > 0) & (np.abs(freqs - mains * np.round(freqs / mains)) > width)
    ok |= (freqs > 0) & (power > 0) & (freqs < mains / 2)
    f = freqs[ok]
    if fit["offset"] is None or len(f) < 3:
        return {"freq": None, "prominence": None, "fwhm": None}
    over = np.log10(power[ok]) - (fit["offset"] - fit["exponent"] * np.log10(f))
    k = int(np.argmax(over))
    half = over[k] / 2
    a = b = k
    while a > 0 and over[a - 1] > half:
        a -= 1
    while b < len(f) - 1 and over[b + 1] > half:
        b += 1
    return {"freq": float(f[k]), "prominence": float(over[k]), "fwhm": float(f[b] - f[a])}


def changepoints(x: np.ndarray, least: int = 5, penalty: float | None = None) -> list[int]:
    """Optimal mean-shift segmentation with pruning: starts of all segments but the first.

    Cost is the squared deviation from the segment mean; the default penalty is 3 ln(n) times the variance.
    """
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 20 or np.median(np.abs(np.diff(x))) < 1e-9:
        return []
    penalty = 3 * np.log(n) * x.var() if penalty is None else penalty
    s1, s2 = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(x * x)))
    best, came = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    open_ = np.array([0])
    for t in range(least, n + 1):
        m = t - open_
        cost = best[open_] + s2[t] - s2[open_] - (s1[t] - s1[open_]) ** 2 / m + penalty
        usable = m >= least
        k = int(np.argmin(np.where(usable, cost, np.inf)))
        best[t], came[t] = (cost[k], open_[k]) if usable.any() else (np.inf, 0)
        open_ = np.append(open_[~usable | (cost - penalty <= best[t])], t - least + 1)
    out, t = [], n
    while t > 0:
        t = came[t]
        if t:
            out.append(int(t))
    return out[::-1]
