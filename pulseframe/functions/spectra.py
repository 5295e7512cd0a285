"""Parametric spectra: an aperiodic part with or without a knee, and peaks above it."""

from __future__ import annotations

import numpy as np

#: Frequency bands with closed ends, the first that holds a peak counts; fixed values.
BANDS = (("delta", 1.0, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 12.0), ("beta", 12.0, 30.0), ("gamma", 30.0, 100.0))


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    return float(slope), float(y.mean() - slope * x.mean())


def aperiodic(f: np.ndarray, p: np.ndarray, knee: bool = False) -> dict[str, float]:
    """log10 p = offset - log10(knee + f^exponent), by least squares; the knee is 0 unless asked for.

    For a given exponent and knee the offset is a mean, so only those two are searched, in ever finer grids.
    """
    f, y = np.asarray(f, float), np.log10(np.asarray(p, float))
    slope, offset = _line(np.log10(f), y)
    if not knee:
        return {"offset": offset, "knee": 0.0, "exponent": -slope}
    best = (np.inf, 0.0, 0.0, 0.0)
    exps, knees = np.linspace(0.1, 5, 25), np.concatenate(([0.0], np.geomspace(f[0] ** 0.5, f[-1] ** 4, 40)))
    for _ in range(8):
        for e in exps:
            model = np.log10(knees[:, None] + f**e)
            off = (y + model).mean(1)
            cost = ((y - off[:, None] + model) ** 2).sum(1)
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (float(cost[k]), float(off[k]), float(knees[k]), float(e))
        step = (exps[-1] - exps[0]) / (len(exps) - 1)
        exps = np.linspace(max(0.01, best[3] - step), best[3] + step, 13)
        ratio = (knees[-1] / knees[1]) ** (1 / (len(knees) - 2)) if len(knees) > 2 and knees[1] > 0 else 2.0
        centre = best[2] or knees[1]
        knees = np.concatenate(([0.0], np.geomspace(centre / ratio, centre * ratio, 25)))
    return {"offset": best[1], "knee": best[2], "exponent": best[3]}


def level(f: np.ndarray, a: dict[str, float]) -> np.ndarray:
    """log10 power of an aperiodic part."""
    return a["offset"] - np.log10(a["knee"] + np.asarray(f, float) ** a["exponent"])


def peaks(f: np.ndarray, p: np.ndarray, a: dict[str, float], most: int = 6, threshold: float = 2.0, least: float = 0.0, widths: tuple[float, float] = (0.5, 12.0)) -> list[tuple[float, float, float]]:
    """(centre, height in log10, width) of Gaussian peaks above the aperiodic part, the highest first.

    The highest point of what is left is a peak if above ``threshold`` standard deviations and ``least``; its width
    comes from the nearer half-height crossing, and it is taken off before the next is looked for.
    """
    f = np.asarray(f, float)
    rest, out = np.log10(p) - level(f, a), []
    while len(out) < most:
        k = int(np.argmax(rest))
        h = float(rest[k])
        if h <= threshold * rest.std() or h <= least:
            break
        below = np.flatnonzero(rest <= h / 2)
        near = np.abs(f[below] - f[k])
        fwhm = 2 * float(near.min()) if len(near) else widths[1]
        sd = float(np.clip(fwhm / 2.3548, widths[0] / 2, widths[1] / 2))
        out.append((float(f[k]), h, 2 * sd))
        rest = rest - h * np.exp(-((f - f[k]) ** 2) / (2 * sd * sd))
    return out


def fit(f: np.ndarray, p: np.ndarray, knee: bool = False, most: int = 6) -> dict:
    """Aperiodic part, refitted without the peaks, the peaks, and r2 of the whole model."""
    f, y = np.asarray(f, float), np.log10(np.asarray(p, float))
    found = peaks(f, p, aperiodic(f, p, knee), most)
    bumps = sum((h * np.exp(-((f - c) ** 2) / (2 * (w / 2) ** 2)) for c, h, w in found), np.zeros(len(f)))
    a = aperiodic(f, 10 ** (y - bumps), knee)
    model = level(f, a) + bumps
    r2 = float(np.corrcoef(model, y)[0, 1] ** 2) if y.std() and model.std() else float("nan")
    return a | {"peaks": found, "r2": r2}


def band_of(centre: float, bands=BANDS) -> str | None:
    """The first band that holds a frequency, ends included."""
    return next((n for n, lo, hi in bands if lo <= centre <= hi), None)


def band_table(found: list[tuple[float, float, float]], bands=BANDS) -> dict[str, tuple[float, float, float, int]]:
    """Per band the mean centre, height and width of its peaks, and how many they are."""
    out = {}
    for n, *_ in bands:
        own = [x for x in found if band_of(x[0], bands) == n]
        if own:
            out[n] = (*(float(np.mean(v)) for v in zip(*own)), len(own))
    return out
