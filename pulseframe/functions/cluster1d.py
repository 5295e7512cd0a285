"""One-dimensional clustering of a feature: bimodality gate and deterministic k-means."""

from __future__ import annotations

import numpy as np

#: Names of clusters in ascending order of their centres, by number of clusters.
LABELS = {2: ("low", "high"), 3: ("low", "mid", "high")}


def fd_bins(x: np.ndarray) -> int:
    """Freedman-Diaconis number of bins, from 10 to 80; from 10 to 50 by the square root where quartiles agree."""
    q1, q3 = np.percentile(x, (25, 75))
    if q3 <= q1:
        return int(np.clip(int(np.sqrt(len(x))), 10, 50))
    return int(np.clip(np.ceil(np.ptp(x) / (2 * (q3 - q1) * len(x) ** (-1 / 3))), 10, 80))


def modes(x: np.ndarray, most: int = 3, height: float = 0.10, valley: float = 0.70) -> int:
    """1 if the values form no separate groups, else how many (2 or 3)."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 8 or np.ptp(x) == 0:
        return 1
    h, _ = np.histogram(x, fd_bins(x))
    h = h / h.max()
    kernel = np.array([1, 2, 3, 2, 1]) / 9
    s = np.convolve(h, kernel, "same")
    inner = np.flatnonzero((s[1:-1] > s[:-2]) & (s[1:-1] > s[2:])) + 1
    if len(inner) < 2:
        return 1
    tall = inner[np.argsort(-h[inner], kind="stable")]
    a, b = sorted(tall[:2])
    low = min(h[a], h[b])
    # the valley is the lowest raw bin strictly between both peaks
    if low < height or b - a < 2 or h[a + 1 : b].min() / low >= valley:
        return 1
    return 3 if most >= 3 and len(tall) > 2 and h[tall[2]] >= height else 2


def _weighted_quantiles(v: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Quantiles, linear between neighbours, of ascending values that stand ``n`` times each."""
    ends = np.cumsum(n)
    place = at * (ends[-1] - 1)
    low = np.floor(place).astype(np.int64)
    value = lambda k: v[np.searchsorted(ends, np.minimum(k, ends[-1] - 1), "right")]
    return value(low) + (place - low) * (value(low + 1) - value(low))


def kmeans(x: np.ndarray, k: int, rounds: int = 100, tol: float = 1e-6, weights: np.ndarray | None = None):
    """(label of each value or -1, centres, cutoffs); None for constant data. Starts from quantiles, so no seed.

    Every distinct value is looked at once, however often it stands; ``weights`` are counts of the given values.
    """
    x = np.asarray(x, float)
    ok = np.isfinite(x)
    v, back = np.unique(x[ok], return_inverse=True)
    n = np.bincount(back, None if weights is None else np.asarray(weights)[ok], minlength=len(v)).astype(np.int64)
    if n.sum() < k or len(v) < 2:
        return None
    c = _weighted_quantiles(v, n, np.linspace(0, 1, k + 2)[1:-1])
    if len(np.unique(c)) < k:
        c = np.linspace(v[0], v[-1], k)
    for _ in range(rounds):
        own = np.abs(v[:, None] - c).argmin(1)
        held, total = np.bincount(own, n, k), np.bincount(own, n * v, k)
        new = np.where(held > 0, total / np.maximum(held, 1), c)
        done = np.abs(new - c).max() <= tol
        c = new
        if done:
            break
    c = np.sort(c, kind="stable")
    labels = np.full(len(x), -1)
    labels[ok] = np.abs(v[:, None] - c).argmin(1)[back]
    return labels, c, (c[1:] + c[:-1]) / 2


def label_feature(x: np.ndarray, most: int = 3, thresholds=None) -> list[str | None]:
    """low/(mid)/high of every value; all null if the feature has a single mode or fewer than 8 distinct values."""
    x = np.asarray(x, float)
    out: list[str | None] = [None] * len(x)
    if thresholds is not None:
        names = LABELS[len(thresholds) + 1]
        for i, v in enumerate(x):
            out[i] = names[int(np.searchsorted(thresholds, v))] if np.isfinite(v) else None
        return out
    if len(np.unique(x[np.isfinite(x)])) < 8 or (k := modes(x, most)) == 1:
        return out
    got = kmeans(x, k)
    return [LABELS[k][j] if j >= 0 else None for j in got[0]] if got else out
