"""Fold-local moments, scalers and linear fits, all by leave-one-out subtraction.

Per-well additive moments are computed once; the training statistics of every fold are
``total - own well``.  Nothing is refitted per fold and the training side is never joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RIDGE_ALPHA, STRIDE, WINDOW
from .cleaning import COLS
from .masking import _with_scalar
from .windows import _candidates, blocks, by_window

#: values are centred on these before summing, so subtraction does not cancel digits
CENTRE = {"gr": 75.0, "rhob": 2.4, "nphi": 0.25}
PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i:]]
MOMENTS = ["n", *[f"s_{c}" for c in COLS], *[f"q_{a}_{b}" for a, b in PAIRS]]


def _centred(c: str) -> Column:
    return F.col(c) - CENTRE[c]


def window_moments(samples: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Additive moments of every intact window: (well, start, n, sums, cross products).

    Samples are combined into blocks of one stride (map-side first) and blocks into windows, so overlap copies no sample.
    """
    if size % stride:
        return (_candidates(samples.select("well", "idx", *COLS), size, stride).groupBy("well", "start")
                .agg(F.count(F.lit(1)).alias("n"), *moment_sums()).where(F.col("n") == size))
    return moments_of_blocks(blocks(samples.select("well", "idx", *COLS), moment_sums(), stride), size, stride)


def moment_sums() -> list[Column]:
    """The additive moments as aggregates."""
    return [*[F.sum(_centred(c)).alias(f"s_{c}") for c in COLS], *[F.sum(_centred(a) * _centred(b)).alias(f"q_{a}_{b}") for a, b in PAIRS]]


def moments_of_blocks(block_rows: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Moments of every intact window from those of its blocks."""
    parts = by_window(block_rows.select("well", "blk", *MOMENTS[1:]), size, stride)
    whole = parts.groupBy("well", "start").agg((F.count(F.lit(1)) * stride).alias("n"), *[F.sum(m).alias(m) for m in MOMENTS[1:]])
    return whole.where(F.col("n") == size)


def well_moments(wm: DataFrame) -> DataFrame:
    """Moments summed over the windows of each well."""
    return wm.groupBy("well").agg(F.count(F.lit(1)).alias("n_windows"), *[F.sum(m).alias(m) for m in MOMENTS])


def leave_one_out(wells: DataFrame) -> DataFrame:
    """Training moments of each fold: the total minus the held-out well."""
    total = wells.agg(*[F.sum(m).alias(f"t_{m}") for m in MOMENTS])
    return _with_scalar(wells, total).select(
        F.col("well"), *[(F.col(f"t_{m}") - F.col(m)).alias(m) for m in MOMENTS]).where("n > 0")


def with_scaler(moments: DataFrame) -> DataFrame:
    """Add mu and population sd (+1e-8) of each channel to a moments table."""
    cols = []
    for c in COLS:
        m = F.col(f"s_{c}") / F.col("n")
        var = F.greatest(F.col(f"q_{c}_{c}") / F.col("n") - m * m, F.lit(0.0))
        cols += [(m + CENTRE[c]).alias(f"mu_{c}"), (F.sqrt(var) + 1e-8).alias(f"sd_{c}")]
    return moments.select("*", *cols)


SCALER = [f"{k}_{c}" for c in COLS for k in ("mu", "sd")]


def fold_moments(samples: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Training moments of every leave-one-well-out fold, keyed by the held-out well."""
    return leave_one_out(well_moments(window_moments(samples, size, stride)))


def fold_scaler(samples: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Scaler of every leave-one-well-out fold, keyed by the held-out well."""
    return with_scaler(fold_moments(samples, size, stride)).select("well", *SCALER)


def standardise(df: DataFrame, scale: DataFrame, cols: list[str] | None = None, prefix: str = "z_") -> DataFrame:
    """(x - mu) / sd with the scaler of the row's own fold."""
    cols = cols or COLS
    return df.join(scale, "well").select(
        *df.columns, *[((F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")).alias(prefix + c) for c in cols])


def inverse(df: DataFrame, scale: DataFrame, cols: list[str] | None = None, prefix: str = "z_") -> DataFrame:
    """z * sd + mu back to physical units."""
    cols = cols or COLS
    keep = [c for c in df.columns if c not in cols]
    return df.join(scale, "well").select(
        *keep, *[(F.col(prefix + c) * F.col(f"sd_{c}") + F.col(f"mu_{c}")).alias(c) for c in cols])


def _cov(a: str, b: str) -> Column:
    """Centred cross product sum of two channels."""
    q = f"q_{a}_{b}" if (a, b) in PAIRS else f"q_{b}_{a}"
    return F.col(q) - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")


def others(c: str) -> list[str]:
    """The predictor channels of one target."""
    return [o for o in COLS if o != c]


def with_ridge(scaled: DataFrame, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """Ridge weights per fold in standardised space: for each target, one weight per predictor.

    Closed form of the 2x2 penalised normal equations; the intercept is unpenalised and
    vanishes because the training means are zero after standardisation.
    """
    cols = []
    for c in COLS:
        a, b = others(c)
        z = lambda p, q: _cov(p, q) / (F.col(f"sd_{p}") * F.col(f"sd_{q}"))
        saa, sbb, sab, say, sby = z(a, a) + alpha, z(b, b) + alpha, z(a, b), z(a, c), z(b, c)
        det = saa * sbb - sab * sab
        cols += [((say * sbb - sby * sab) / det).alias(f"w_{c}_{a}"), ((sby * saa - say * sab) / det).alias(f"w_{c}_{b}")]
    return scaled.select("*", *cols)


def bayes_fits(scaled: DataFrame, max_iter: int = 300, tol: float = 1e-3) -> DataFrame:
    """Bayesian ridge weights per fold by evidence maximisation, from moments only.

    Noise and weight precisions are re-estimated until the weights move less than ``tol``.
    One vectorised pass over batches of folds; each fold is a 2x2 problem.
    """
    z = lambda p, q: _cov(p, q) / (F.col(f"sd_{p}") * F.col(f"sd_{q}"))
    flat = scaled.select("well", F.col("n").cast("double").alias("n"),
                         *[z(a, b).alias(f"z_{a}_{b}") for a, b in PAIRS])
    names = [f"b_{c}_{o}" for c in COLS for o in others(c)]

    def fit(frames):
        for pdf in frames:
            out = {"well": pdf["well"]}
            for c in COLS:
                a, b = others(c)
                g = lambda p, q: pdf[f"z_{p}_{q}" if (p, q) in PAIRS else f"z_{q}_{p}"].to_numpy()
                wa, wb = _evidence(pdf["n"].to_numpy(), g(a, a), g(b, b), g(a, b), g(a, c), g(b, c), g(c, c), max_iter, tol)
                out[f"b_{c}_{a}"], out[f"b_{c}_{b}"] = wa, wb
            yield pd.DataFrame(out)

    kind = dict(scaled.dtypes)["well"]
    return flat.mapInPandas(fit, f"well {kind}, " + ", ".join(f"{n} double" for n in names))


def fold_fits(moments: DataFrame, methods: tuple[str, ...] = ("mean",)) -> DataFrame:
    """Everything the linear imputers need per fold: scaler, ridge and chained weights."""
    scaled = with_scaler(moments)
    keep = ["well", *SCALER]
    if "ridge" in methods:
        scaled = with_ridge(scaled)
        keep += [f"w_{c}_{o}" for c in COLS for o in others(c)]
    out = scaled.select(*keep)
    return out.join(bayes_fits(with_scaler(moments)), "well") if "mice" in methods else out


def _evidence(n, saa, sbb, sab, say, sby, syy, max_iter, tol):
    """Evidence iteration on arrays of 2x2 systems."""
    tiny = 1e-6
    # eigenvalues of the 2x2 Gram matrix
    mid, dif = (saa + sbb) / 2, np.sqrt(((saa - sbb) / 2) ** 2 + sab ** 2)
    eig = np.stack([mid + dif, np.maximum(mid - dif, 0.0)])
    alpha, lam = 1.0 / (syy / n + np.finfo(float).eps), np.ones_like(n)

    def solve(ratio):
        paa, pbb = saa + ratio, sbb + ratio
        det = paa * pbb - sab ** 2
        wa, wb = (say * pbb - sby * sab) / det, (sby * paa - say * sab) / det
        sse = syy - 2 * (wa * say + wb * sby) + wa ** 2 * saa + wb ** 2 * sbb + 2 * wa * wb * sab
        return wa, wb, np.maximum(sse, 0.0)

    done = np.zeros(n.shape, bool)
    old = None
    for i in range(max_iter):
        wa, wb, sse = solve(lam / alpha)
        gamma = (alpha * eig / (lam + alpha * eig)).sum(0)
        lam_new = (gamma + 2 * tiny) / (wa ** 2 + wb ** 2 + 2 * tiny)
        alpha_new = (n - gamma + 2 * tiny) / (sse + 2 * tiny)
        lam, alpha = np.where(done, lam, lam_new), np.where(done, alpha, alpha_new)
        if i and old is not None:
            done |= np.abs(old[0] - wa) + np.abs(old[1] - wb) < tol
            if done.all():
                break
        old = (wa, wb)
    wa, wb, _ = solve(lam / alpha)
    return wa, wb
