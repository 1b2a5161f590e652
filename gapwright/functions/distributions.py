"""Distribution functions in NumPy for small, already aggregated tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1.0 - lead * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return lead * h


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution."""
    return _gamma_q(df / 2, x / 2)


def _beta_cf(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return lead * _beta_cf(a, b, x) / a
    return 1 - lead * _beta_cf(b, a, 1 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    """Upper quantile of Student's t (p > 0.5) by bisection."""
    lo, hi = 0.0, 1e8
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_sf2(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def normal_sf2(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def wilcoxon_exact_p(w_min: float, n: int) -> float:
    """Two-sided exact p of the signed-rank statistic (no ties, no zeros)."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for k in range(1, n + 1):
        counts[k:] = counts[k:] + counts[:-k].copy() if k < len(counts) else counts[k:]
    return float(min(1.0, 2 * counts[: int(w_min) + 1].sum() / 2.0 ** n))


def wilcoxon_p(w_min: float, n: int, n_zero: int, tie_term: float) -> float:
    """Exact for up to 50 untied non-zero differences, else the tie-corrected normal tail."""
    if n <= 50 and n_zero == 0 and tie_term == 0:
        return wilcoxon_exact_p(w_min, n)
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    return normal_sf2((w_min - mean) / math.sqrt(var)) if var > 0 else float("nan")


_GRID = np.linspace(-8.5, 8.5, 6801)
_PHI = np.exp(-_GRID ** 2 / 2) / math.sqrt(2 * math.pi)
_CDF = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in _GRID])


def range_sf(q: float, k: int) -> float:
    """Upper tail of the studentised range with infinite degrees of freedom."""
    if q <= 0:
        return 1.0
    low = np.interp(_GRID - q, _GRID, _CDF, left=0.0, right=1.0)
    return float(min(1.0, max(0.0, 1 - k * np.trapezoid(_PHI * (_CDF - low) ** (k - 1), _GRID))))


def _elementwise(fn):
    def run(*cols: pd.Series) -> pd.Series:
        def one(*v):
            return None if any(x is None or (isinstance(x, float) and math.isnan(x)) for x in v) else fn(*v)
        return pd.Series([one(*row) for row in zip(*cols)], dtype="float64")
    return run


def column(fn, *cols):
    """Apply a distribution function to columns of an aggregated table."""
    return _udf(fn)(*cols)


def _udf(fn):
    n = fn.__code__.co_argcount
    body = _elementwise(fn)
    if n == 2:
        def call(a: pd.Series, b: pd.Series) -> pd.Series:
            return body(a, b)
    elif n == 4:
        def call(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            return body(a, b, c, d)
    else:
        raise ValueError("two or four arguments")
    return F.pandas_udf(call, T.DoubleType())
