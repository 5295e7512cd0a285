"""Regression and resampling kernels."""

from __future__ import annotations

import numpy as np


def zscore(a: np.ndarray) -> np.ndarray:
    sd = a.std(0)
    return (a - a.mean(0)) / np.where(sd == 0, 1, sd)


def ridge_path(x: np.ndarray, y: np.ndarray, alphas: np.ndarray):
    """(best alpha by leave-one-out error, its coefficients) for standardised x and y, from one decomposition."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    uy = u.T @ y
    n = len(y)
    best = None
    for a in alphas:
        shrink = s**2 / (s**2 + a)
        fit = u @ (shrink * uy)
        lever = (u**2 * shrink).sum(1) + 1 / n
        err = float((((y - fit) / np.maximum(1 - lever, 1e-12)) ** 2).mean())
        if best is None or err < best[0]:
            best = (err, a, vt.T @ (s / (s**2 + a) * uy))
    return best[1], best[2]


def ridge_fit(x: np.ndarray, y: np.ndarray, a: float) -> np.ndarray:
    return np.linalg.solve(x.T @ x + a * np.eye(x.shape[1]), x.T @ y)


def r2(y: np.ndarray, fit: np.ndarray) -> float:
    ss = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - fit) ** 2).sum() / ss) if ss > 0 else float("nan")


def folds(n: int, k: int, seed: int) -> list[np.ndarray]:
    return np.array_split(np.random.default_rng(seed).permutation(n), k)


def ridge_cv(x: np.ndarray, y: np.ndarray, k: int = 5, permutations: int = 100, seed: int = 42, alphas=None) -> dict | None:
    """Cross-validated R2 with a permutation p, best alpha and standardised coefficients; null below 20 complete rows."""
    ok = np.isfinite(x).all(1) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if len(y) < 20 or y.std() == 0:
        return None
    x, y = zscore(x), zscore(y)
    alpha, beta = ridge_path(x, y, np.logspace(-3, 3, 100) if alphas is None else alphas)
    parts = folds(len(y), k, seed)

    def score(t):
        out = []
        for test in parts:
            train = np.setdiff1d(np.arange(len(t)), test)
            b = ridge_fit(x[train], t[train] - t[train].mean(), alpha)
            out.append(r2(t[test], x[test] @ b + t[train].mean()))
        return float(np.mean(out))

    got = score(y)
    rng = np.random.default_rng(seed)
    null = np.array([score(rng.permutation(y)) for _ in range(permutations)])
    return {"n": len(y), "r2": got, "alpha": float(alpha), "beta": beta.tolist(), "p": float((1 + (null >= got).sum()) / (1 + permutations)), "null_mean": float(null.mean()), "null_std": float(null.std())}


def ols_hc3(x: np.ndarray, y: np.ndarray) -> dict:
    """Least squares with intercept and HC3 standard errors."""
    a = np.column_stack((np.ones(len(y)), x))
    inv = np.linalg.pinv(a.T @ a)
    b = inv @ a.T @ y
    rest = y - a @ b
    lever = np.einsum("ij,jk,ik->i", a, inv, a)
    w = (rest / np.maximum(1 - lever, 1e-12)) ** 2
    cov = inv @ (a.T * w) @ a @ inv
    return {"beta": b, "se": np.sqrt(np.diag(cov)), "r2": r2(y, a @ b)}


def nested_f(r2_full: float, r2_part: float, n: int, p_full: int, p_part: int) -> float | None:
    """F statistic of a full model against one nested in it."""
    d1, d2 = p_full - p_part, n - p_full - 1
    return (r2_full - r2_part) / d1 / ((1 - r2_full) / d2) if d1 > 0 and d2 > 0 and r2_full < 1 else None


def levenberg(residual, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Bounded least squares by damped Gauss-Newton steps clipped to the box: (parameters, squared error)."""
    p = np.clip(np.asarray(start, float), lo, hi)
    r = residual(p)
    err, damp = float(r @ r), 1e-3
    for _ in range(rounds):
        h = 1e-6 * np.maximum(1.0, np.abs(p))
        jac = np.column_stack([(residual(np.clip(p + h[i] * np.eye(len(p))[i], lo - 1, hi + 1)) - r) / h[i] for i in range(len(p))])
        grad = jac.T @ r
        free = ~(((p <= lo) & (grad > 0)) | ((p >= hi) & (grad < 0)))
        if not free.any():
            break
        a = jac[:, free].T @ jac[:, free]
        moved = False
        while damp < 1e12:
            step = np.zeros(len(p))
            step[free] = -np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), grad[free], rcond=None)[0]
            q = np.clip(p + step, lo, hi)
            s = residual(q)
            new = float(s @ s)
            if new < err:
                moved = True
                gain = err - new
                p, r, err, damp = q, s, new, damp / 5
                break
            damp *= 4
        if not moved or gain < 1e-12 * (err + 1e-30):
            break
    return p, err


def sigmoids(t: np.ndarray, y: np.ndarray, most: int = 3) -> dict | None:
    """Step-like changes of a smoothed label series as a sum of 1 to 3 logistic terms, chosen by AIC.

    None if the range is below 0.15. Terms beyond the first are tried only while the fit is below 0.95.
    """
    t, y = np.asarray(t, float), np.asarray(y, float)
    if len(y) < 10 or np.ptp(y) < 0.15 or np.ptp(t) == 0:
        return None
    if len(t) > 300:
        keep = np.linspace(0, len(t) - 1, 300).astype(int)
        t, y = t[keep], y[keep]
    u = (t - t[0]) / np.ptp(t)
    span, best = np.ptp(y), None
    for k in range(1, most + 1):

        def model(p):
            z = np.full(len(u), p[0])
            for a, c, s in p[1:].reshape(-1, 3):
                z = z + a / (1 + np.exp(-np.clip(s * (u - c), -60, 60)))
            return z

        jumps = np.diff(np.interp(np.linspace(0, 1, k + 1), u, y))
        start = np.concatenate(([y[0]], np.column_stack((jumps, (np.arange(k) + 0.5) / k, np.full(k, 20.0))).ravel()))
        lo = np.concatenate(([y.min() - span], np.tile((-2 * span, 0.0, 2.0), k)))
        hi = np.concatenate(([y.max() + span], np.tile((2 * span, 1.0, 300.0), k)))
        p, err = levenberg(lambda q: model(q) - y, start, lo, hi)
        aic = len(y) * np.log(max(err, 1e-12) / len(y)) + 2 * (1 + 3 * k) + (30 if k > 1 else 0)
        fit = r2(y, model(p))
        if best is None or aic < best["aic"]:
            best = {"k": k, "aic": float(aic), "r2": fit, "centres": (t[0] + np.ptp(t) * p[2::3]).tolist(), "heights": p[1::3].tolist()}
        if fit >= 0.95:
            break
    return best
