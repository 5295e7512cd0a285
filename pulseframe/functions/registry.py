"""Registers the kernels as Arrow UDFs that can be called from SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import cluster1d, distributions, signals

_TESTS = {
    "p_normal": (distributions.norm_two_sided, 1),
    "p_t": (distributions.t_two_sided, 2),
    "p_f": (distributions.f_sf, 3),
    "p_chi2": (distributions.chi2_sf, 2),
    "p_pearson": (lambda r, n: distributions.pearson_p(r, int(n)), 2),
    "p_binom": (lambda k, n, p: distributions.binom_greater(int(k), int(n), p), 3),
}


def _test_udf(fn, arity: int):
    def values(*cols):
        out = []
        for row in zip(*cols):
            ok = all(v is not None and v == v for v in row)
            out.append(fn(*map(float, row)) if ok else None)
        return pd.Series(out, dtype="float64")

    if arity == 1:

        def run(a: pd.Series) -> pd.Series:
            return values(a)

    elif arity == 2:

        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return values(a, b)

    else:

        def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return values(a, b, c)

    return F.pandas_udf(run, "double")


def test_udfs() -> dict:
    """Tail probabilities of test statistics: name to UDF; null or NaN arguments give null."""
    return {name: _test_udf(fn, arity) for name, (fn, arity) in _TESTS.items()}


def array_udfs() -> dict:
    """Kernels over an array of doubles."""

    def peak_count(a: pd.Series) -> pd.Series:
        return pd.Series([len(signals.find_peaks(np.asarray(v, float), -np.inf)) if v is not None else None for v in a], dtype="Int64")

    def exponent(a: pd.Series) -> pd.Series:
        out = []
        for v in a:
            if v is None or len(v) < 16:
                out.append(None)
                continue
            f, p = signals.welch_psd(np.asarray(v, float), 1.0, min(len(v), 64))
            out.append(signals.aperiodic_fit(f, p, f[1], f[-1])["exponent"])
        return pd.Series(out, dtype="float64")

    def mode_count(a: pd.Series) -> pd.Series:
        return pd.Series([cluster1d.modes(np.asarray(v, float)) if v is not None else None for v in a], dtype="Int64")

    return {"peak_count": F.pandas_udf(peak_count, "long"), "aperiodic_exponent": F.pandas_udf(exponent, "double"), "mode_count": F.pandas_udf(mode_count, "long")}


def register(spark: SparkSession) -> list[str]:
    """Register all of them; returns the names."""
    found = test_udfs() | array_udfs()
    for name, f in found.items():
        spark.udf.register(name, f)
    return sorted(found)
