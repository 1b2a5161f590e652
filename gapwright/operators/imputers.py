"""Within-window imputers.

Contract: the input carries (well, start, t, truth channels, ``mask_bits``, ``x_<log>``) plus
any cell keys; predictions come back in physical units and only masked positions are
predicted.  Carry-forward and interpolation commute with the affine scaler, so they run on
physical values and only the "nothing observed" case needs the fold mean.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cleaning import COLS
from .scaling import others

CELL = ["scenario", "mask_seed"]
SEQUENTIAL = ("locf", "locf_win", "interp_linear", "interp_pchip")
LINEAR = ("mean", "ridge", "mice")
NATIVE = ("mean", "locf", "locf_win", "interp_linear", "interp_pchip", "ridge", "mice")


def _bit(i: int) -> Column:
    return F.col("mask_bits").bitwiseAND(1 << i) > 0


def add_neighbours(df: DataFrame, keys: Sequence[str], order: str = "t", after: bool = True,
                   depth: bool = True, deep: bool = False) -> DataFrame:
    """Add the observed knots around each position, per log.

    ``by_`` / ``ay_`` hold the value of the knot before / after, ``bt_`` / ``at_`` its
    position (with ``depth``); ``deep`` adds the knot beyond it as ``boy_, bot_, aoy_, aot_``.
    Both directions scan with a running frame, the second one over the reversed order, so a
    window costs one pass.  Plain columns are carried: structs are an order slower here.
    """
    fwd = Window.partitionBy(*keys).orderBy(F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    rev = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    for side, w in [("b", fwd)] + ([("a", rev)] if after else []):
        cols = []
        for c in COLS:
            cols.append(F.last(f"x_{c}", True).over(w).alias(f"{side}y_{c}"))
            if depth:
                at = F.when(F.col(f"x_{c}").isNotNull(), F.col(order))
                cols.append(F.last(at, True).over(w).alias(f"{side}t_{c}"))
        df = df.select("*", *cols)
        if deep:
            df = df.select("*", *[
                F.last(F.when(F.col(f"x_{c}").isNotNull(), F.col(f"{side}{k}_{c}")), True).over(w).alias(f"{side}o{k}_{c}")
                for c in COLS for k in "ty"])
    return df


def add_slopes(df: DataFrame) -> DataFrame:
    """Shape-preserving slopes ``db_<log>`` / ``da_<log>`` at the two knots around a position.

    An inner knot takes the weighted harmonic mean of its two chords.  An outermost knot
    takes the one-sided three-point estimate over the next knot and the one beyond it.
    NULL below three knots.  Chords are projected first so nothing is computed twice.
    """
    cols = df.columns
    chords = []
    for c in COLS:
        for name, p, q in (("l", "bo", "b"), ("m", "b", "a"), ("r", "a", "ao")):
            h = F.col(f"{q}t_{c}") - F.col(f"{p}t_{c}")
            chords += [h.alias(f"_h{name}_{c}"), ((F.col(f"{q}y_{c}") - F.col(f"{p}y_{c}")) / h).alias(f"_m{name}_{c}")]
    df = df.select(*cols, *chords)
    ends = []
    for c in COLS:
        g = lambda k: F.col(f"{k}_{c}")  # noqa: E731,B023
        for side in "lr":
            ends.append((((2 * g("_hm") + g(f"_h{side}")) * g("_mm") - g("_hm") * g(f"_m{side}"))
                         / (g("_hm") + g(f"_h{side}"))).alias(f"_e{side}_{c}"))
    df = df.select(*df.columns, *ends)
    out = []
    for c in COLS:
        g = lambda k: F.col(f"{k}_{c}")  # noqa: E731,B023
        for name, side, far in (("db", "l", "r"), ("da", "r", "l")):
            w0, w1 = 2 * g("_hm") + g(f"_h{side}"), g("_hm") + 2 * g(f"_h{side}")
            inner = F.when(g(f"_m{side}") * g("_mm") <= 0, 0.0).otherwise(
                (w0 + w1) / (w0 / g(f"_m{side}") + w1 / g("_mm")))
            d, near, beyond = g(f"_e{far}"), g("_mm"), g(f"_m{far}")
            outer = (F.when(F.signum(d) != F.signum(near), 0.0)
                     .when((F.signum(near) != F.signum(beyond)) & (F.abs(d) > 3 * F.abs(near)), 3 * near).otherwise(d))
            out.append(F.when(g(f"_m{side}").isNotNull(), inner).when(beyond.isNotNull(), outer).alias(f"{name}_{c}"))
    return df.select(*cols, *out)


def locf(c: str) -> Column:
    """Last observed value above."""
    return F.col(f"by_{c}")


def interp_linear(c: str, order: str = "t") -> Column:
    """Bracketed linear interpolation, constant beyond the outer knots."""
    by, ay, bt, at = (F.col(f"{k}_{c}") for k in ("by", "ay", "bt", "at"))
    inside = by + (ay - by) * (F.col(order) - bt) / (at - bt)
    return F.when(by.isNotNull() & ay.isNotNull(), inside).otherwise(F.coalesce(by, ay))


def interp_pchip(c: str, order: str = "t") -> Column:
    """Cubic Hermite on the shape-preserving slopes; linear below three knots or outside."""
    by, ay, bt, at, db, da = (F.col(f"{k}_{c}") for k in ("by", "ay", "bt", "at", "db", "da"))
    h = at - bt
    s = (F.col(order) - bt) / h
    cubic = ((1 + 2 * s) * (1 - s) * (1 - s) * by + s * (1 - s) * (1 - s) * h * db
             + s * s * (3 - 2 * s) * ay + s * s * (s - 1) * h * da)
    return F.when(db.isNotNull() & da.isNotNull(), cubic).otherwise(interp_linear(c, order))


def zscore(c: str) -> Column:
    """Standardised model input; missing becomes 0, the training mean."""
    return F.coalesce((F.col(f"x_{c}") - F.col(f"mu_{c}")) / F.col(f"sd_{c}"), F.lit(0.0))


def _physical(c: str, z: Column) -> Column:
    return z * F.col(f"sd_{c}") + F.col(f"mu_{c}")


def chained(prefix: str, order: Sequence[int] = (0, 1, 2)) -> dict[str, Column]:
    """One chained sweep: each missing channel is regressed on the current state of the others.

    ``prefix`` names the weights, ``w`` for ridge and ``b`` for Bayesian ridge.  A predicted channel counts as its
    prediction for the channels after it; one not reached yet counts as its training mean.
    """
    state = {c: zscore(c) for c in COLS}
    for i in order:
        c = COLS[i]
        a, b = others(c)
        fit = F.col(f"{prefix}_{c}_{a}") * state[a] + F.col(f"{prefix}_{c}_{b}") * state[b]
        state[c] = F.when(_bit(i), fit).otherwise(state[c])
    return {c: _physical(c, z) for c, z in state.items()}


def predict(masked: DataFrame, fits: DataFrame, methods: Sequence[str], keys: Sequence[str] = ("well", "start"),
            order: str = "t") -> DataFrame:
    """Rows with a masked channel plus ``p_<method>_<log>`` in physical units."""
    unknown = set(methods) - set(NATIVE)
    if unknown:
        raise ValueError(f"not a window imputer: {sorted(unknown)}")
    cell = [k for k in CELL if k in masked.columns]
    df = masked
    interp = any(m.startswith("interp") for m in methods)
    if set(methods) & set(SEQUENTIAL):
        df = add_neighbours(df, [*cell, *keys], order,
                            after=interp, depth=interp, deep="interp_pchip" in methods)
    df = df.where("mask_bits > 0").join(fits, "well")
    keep = [c for c in masked.columns if not c.startswith("x_")] + [c for c in ("config",) if c in fits.columns]
    return _predicted(df, methods, keep, order)


def _predicted(df: DataFrame, methods: Sequence[str], keep: Sequence[str], order: str) -> DataFrame:
    """``keep`` and ``p_<method>_<log>`` of rows that carry knots, model inputs and the fits of their fold."""
    if "interp_pchip" in methods:
        df = add_slopes(df)
    chain = {m: chained(p) for m, p in (("ridge", "w"), ("mice", "b")) if m in methods}
    cols = []
    for m in methods:
        for c in COLS:
            mu = F.col(f"mu_{c}")
            p = {
                "mean": lambda: mu,
                "locf": lambda: F.coalesce(locf(c), mu),
                "locf_win": lambda: F.coalesce(locf(c), mu),
                "interp_linear": lambda: F.coalesce(interp_linear(c, order), mu),
                "interp_pchip": lambda: F.coalesce(interp_pchip(c, order), mu),
                "ridge": lambda: chain["ridge"][c],
                "mice": lambda: chain["mice"][c],
            }[m]()
            cols.append(p.alias(f"p_{m}_{c}"))
    return df.select(*keep, *cols)


def _run_rows(specs: DataFrame, methods: Sequence[str], size: int) -> tuple[DataFrame, list[str], list[str]]:
    """One row per masked run: its fits, the knots around it and the masked stretch ``v_<log>`` of every array."""
    unknown = set(methods) - set(NATIVE)
    if unknown:
        raise ValueError(f"not a window imputer: {sorted(unknown)}")
    arrays = [f"a_{c}" for c in COLS]
    fits = [c for c in specs.columns if c not in {"well", "start", *arrays, *CELL, "mask_bits", "runs"}]
    df = specs.select("well", "start", *CELL, "mask_bits", *arrays, *fits, F.explode("runs").alias("r"))
    knots = []
    if set(methods) & set(SEQUENTIAL):
        sides = [("by", "bt", "r.a - 1"), ("ay", "at", "r.b")]
        sides += [("boy", "bot", "r.before"), ("aoy", "aot", "r.after")] if "interp_pchip" in methods else []
        for c in COLS:
            for y, t, at in sides:
                there = f"{at} >= 0 AND {at} < {size}"
                knots += [F.expr(f"CASE WHEN {there} THEN a_{c}[{at}] END").alias(f"{y}_{c}"), F.expr(f"CASE WHEN {there} THEN {at} END").alias(f"{t}_{c}")]
    # only the masked stretch of each array leaves the run's row
    cut = [F.slice(f"a_{c}", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")).alias(f"v_{c}") for c in COLS]
    df = df.select("well", "start", *CELL, "mask_bits", *fits, *knots, F.col("r.a").alias("a"), F.col("r.b").alias("b"), *cut)
    return df, fits, [c for c in df.columns if c[:2] in ("by", "bt", "ay", "at", "bo", "ao")]


def predict_runs(specs: DataFrame, methods: Sequence[str], size: int) -> DataFrame:
    """Predictions of :func:`predict` at the masked positions of window rows.

    ``specs`` holds the arrays ``a_<log>`` of an intact window, its mask (scenario, mask_seed, mask_bits, runs) and the fits of
    its fold.  All positions outside the runs are measured, so the knots around a run are looked up at its ends; only masked
    positions become rows and nothing is sorted or shuffled.
    """
    df, fits, knots = _run_rows(specs, methods, size)
    cut = F.arrays_zip(F.expr("sequence(a, b - 1)").alias("t"), *[F.col(f"v_{c}").alias(c) for c in COLS])
    df = df.select("well", "start", *CELL, "mask_bits", *fits, *knots, F.explode(F.array(cut)).alias("cut"))
    df = df.select(*[c for c in df.columns if c != "cut"], F.inline("cut").alias("t", *COLS))
    inputs = [F.when(~_bit(i), F.col(c)).alias(f"x_{c}") for i, c in enumerate(COLS)]
    keep = ["well", "start", "t", *COLS, *CELL, "mask_bits"]
    return _predicted(df.select("*", *inputs), methods, keep, "t")


def run_sums(specs: DataFrame, methods: Sequence[str], size: int) -> DataFrame:
    """Additive sums of the predictions of :func:`predict_runs`, without a row per masked position.

    Rows (well, scenario, mask_seed) may come in several parts.  Per log: ``n_``, ``y_`` and ``yy_`` (count, sum and sum of
    squares of the truth); per method and log: ``sse_<method>_``, ``sae_<method>_``.  A batch of runs is worked off as flat arrays.
    """
    df, fits, _ = _run_rows(specs, methods, size)
    if "interp_pchip" in methods:
        df = add_slopes(df)                         # slopes belong to the run, not to its positions
    return sums_of_runs(df.drop("start"), methods, ["well", *CELL])


def sums_of_runs(df: DataFrame, methods: Sequence[str], keys: Sequence[str], extra: dict | None = None) -> DataFrame:
    """The sums of :func:`run_sums` by ``keys`` from finished run rows.

    A run row carries ``mask_bits``, ``a``, the truth ``v_<log>`` from position ``a`` on (or at the positions ``v_t``), its knots
    and its fits.  ``extra`` holds predictors that replace those of a method: (column reader, log, mean, run, position) -> values.
    """
    keys = list(keys)
    names = [f"{k}_{c}" for c in COLS for k in ("n", "y", "yy", *[f"{e}_{m}" for m in methods for e in ("sse", "sae")])]
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField(k, T.LongType() if k.startswith("n_") else T.DoubleType()) for k in names])

    def sums(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            table = {k: rb.column(k) for k in keys}
            table.update(_run_sums(rb, methods, extra))
            whole = pa.table(table).group_by(keys, use_threads=False).aggregate([(k, "sum") for k in names])
            yield from pa.table({k: whole[k if k in keys else f"{k}_sum"] for k in [*keys, *names]}).to_batches()

    return df.mapInArrow(sums, schema)


def points_of_runs(df: DataFrame, methods: Sequence[str], keys: Sequence[str], order: str, extra: dict | None = None) -> DataFrame:
    """Rows (keys, position, method, log, pred, truth) of the run rows of :func:`sums_of_runs`."""
    keys = list(keys)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(order, T.LongType()), T.StructField("method", T.StringType()),
                          T.StructField("log", T.StringType()), T.StructField("pred", T.DoubleType()), T.StructField("truth", T.DoubleType())])

    def points(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            for c, r, at, y, guess in _run_points(rb, methods, extra):
                for m in methods:
                    table = {**{k: rb.column(k).take(pa.array(r)) for k in keys}, order: at.astype("int64"), "method": [m] * len(r),
                             "log": [c.upper()] * len(r), "pred": guess(m), "truth": y}
                    yield from pa.table(table, schema=pa.schema([*[rb.schema.field(k) for k in keys], (order, pa.int64()), ("method", pa.string()),
                                                                 ("log", pa.string()), ("pred", pa.float64()), ("truth", pa.float64())])).to_batches(10_000)

    return df.mapInArrow(points, schema)


def _run_sums(rb: pa.RecordBatch, methods: Sequence[str], extra: dict | None = None) -> dict[str, np.ndarray]:
    """The sums of :func:`run_sums` for every run of a batch."""
    n, out = rb.num_rows, {}
    for c, r, _, y, guess in _run_points(rb, methods, extra):
        add = lambda v: np.bincount(r, weights=v, minlength=n).astype(float)  # noqa: E731,B023  (of nothing it counts in integers)
        out[f"n_{c}"], out[f"y_{c}"], out[f"yy_{c}"] = np.bincount(r, minlength=n).astype("int64"), add(y), add(y * y)
        for m in methods:
            e = guess(m) - y
            out[f"sse_{m}_{c}"], out[f"sae_{m}_{c}"] = add(e * e), add(np.abs(e))
    return out


def _run_points(rb: pa.RecordBatch, methods: Sequence[str], extra: dict | None = None):
    """Per log of a batch of runs: (log, run of each masked position, the position, truth there, prediction by method)."""
    col = lambda name: rb.column(name).to_numpy(zero_copy_only=False).astype(float)
    first, bits = rb.column("a").to_numpy(), rb.column("mask_bits").to_numpy()
    length = pc.list_value_length(rb.column(f"v_{COLS[0]}")).to_numpy()
    row = np.repeat(np.arange(rb.num_rows), length)
    if "v_t" in rb.schema.names:
        t = rb.column("v_t").flatten().to_numpy()
    else:
        t = np.arange(len(row)) - np.repeat(np.cumsum(length) - length - first, length)
    truth = {c: rb.column(f"v_{c}").flatten().to_numpy(zero_copy_only=False) for c in COLS}
    mu, sd = ({c: col(f"{k}_{c}") for c in COLS} for k in ("mu", "sd"))
    hit = {c: (bits & (1 << i) > 0)[row] for i, c in enumerate(COLS)}
    chain = {}
    for m, prefix in (("ridge", "w"), ("mice", "b")):
        if m in methods:
            z = {c: np.where(hit[c], 0.0, (truth[c] - mu[c][row]) / sd[c][row]) for c in COLS}
            for c in COLS:
                a, b = others(c)
                fit = col(f"{prefix}_{c}_{a}")[row] * z[a] + col(f"{prefix}_{c}_{b}")[row] * z[b]
                z[c] = np.where(hit[c], fit, z[c])
            chain[m] = z
    for c in COLS:
        r, y, at = row[hit[c]], truth[c][hit[c]], t[hit[c]]

        def guess(m):
            if extra and m in extra:
                return extra[m](col, c, mu[c], r, at)  # noqa: B023
            if m == "mean":
                return mu[c][r]  # noqa: B023
            if m in chain:
                return chain[m][c][hit[c]] * sd[c][r] + mu[c][r]  # noqa: B023
            return _run_knots(m, col, c, mu[c], r, at)  # noqa: B023

        yield c, r, at, y, guess


def run_moments(specs: DataFrame, methods: Sequence[str], size: int, keys: Sequence[str]) -> DataFrame:
    """Moments of truth and prediction over the points of :func:`predict_runs`, without a row per masked position.

    Rows (keys, method, log, n, mean and centred square sum of truth ``my, vy`` and prediction ``mp, vp``, their centred product
    sum ``vyp``, sse, sae), one for each batch of runs that holds such points; they are put together by
    :func:`gapwright.operators.metrics.metrics_of_moments`.
    """
    df, _, _ = _run_rows(specs, methods, size)
    if "interp_pchip" in methods:
        df = add_slopes(df)
    keys = list(keys)
    sums = ["my", "vy", "mp", "vp", "vyp", "sse", "sae"]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("method", T.StringType()), T.StructField("log", T.StringType()),
                                                          T.StructField("n", T.LongType())] + [T.StructField(k, T.DoubleType()) for k in sums])

    def moments(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            cells = pa.table({k: rb.column(k) for k in keys}).to_pandas()
            cell = cells.groupby(keys, sort=False).ngroup().to_numpy()
            cells = cells.drop_duplicates()
            for c, r, _, y, guess in _run_points(rb, methods):
                g = cell[r]
                for m in methods:
                    part = _moments(g, y, guess(m), len(cells))
                    live = part["n"] > 0
                    out = {**{k: pa.array(cells[k][live], type=rb.schema.field(k).type) for k in keys}, "method": [m] * int(live.sum()),
                           "log": [c.upper()] * int(live.sum()), **{k: v[live] for k, v in part.items()}}
                    yield from pa.table(out).to_batches()

    return df.drop(*[k for k in ("well", "start", *CELL) if k not in keys]).mapInArrow(moments, schema)


def _moments(g: np.ndarray, y: np.ndarray, p: np.ndarray, n_groups: int) -> dict[str, np.ndarray]:
    """Moments of (y, p) by group; values are taken from the first one of their group, so equal values have a spread of exactly 0."""
    n = np.bincount(g, minlength=n_groups).astype("int64")
    add = lambda v: np.bincount(g, weights=v, minlength=n_groups).astype(float)
    out, off = {"n": n}, {}
    for name, x in (("y", y), ("p", p)):
        first = np.zeros(n_groups)
        first[g[::-1]] = x[::-1]
        d = x - first[g]
        mean = add(d) / np.maximum(n, 1)
        off[name] = d - mean[g]
        out[f"m{name}"], out[f"v{name}"] = first + mean, add(off[name] ** 2)
    out["vyp"], e = add(off["y"] * off["p"]), p - y
    out["sse"], out["sae"] = add(e * e), add(np.abs(e))
    return out


def _run_knots(method: str, col, c: str, mu: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Carry-forward, linear or cubic prediction at positions ``t`` of the runs ``r``; no knot position means no knot."""
    by, bt = col(f"by_{c}"), col(f"bt_{c}")
    above = np.isfinite(bt)
    if method in ("locf", "locf_win"):
        return np.where(above, by, mu)[r]
    ay, at = col(f"ay_{c}"), col(f"at_{c}")
    below = np.isfinite(at)
    flat = np.where(above, by, np.where(below, ay, mu))
    with np.errstate(invalid="ignore"):
        linear = np.where((above & below)[r], by[r] + (ay - by)[r] * (t - bt[r]) / (at - bt)[r], flat[r])
        if method == "interp_linear":
            return linear
        db, da, h = col(f"db_{c}"), col(f"da_{c}"), (at - bt)[r]
        s = (t - bt[r]) / h
        cubic = ((1 + 2 * s) * (1 - s) * (1 - s) * by[r] + s * (1 - s) * (1 - s) * h * db[r]
                 + s * s * (3 - 2 * s) * ay[r] + s * s * (s - 1) * h * da[r])
    return np.where((np.isfinite(db) & np.isfinite(da))[r], cubic, linear)


def to_points(pred: DataFrame, methods: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (position, masked channel, method): pred and truth."""
    per_log = [
        F.when(_bit(i), F.array(*[
            F.struct(F.lit(m).alias("method"), F.lit(c.upper()).alias("log"),
                     F.col(f"p_{m}_{c}").alias("pred"), F.col(c).alias("truth")) for m in methods]))
        for i, c in enumerate(COLS)]
    rows = F.flatten(F.filter(F.array(*per_log), lambda v: v.isNotNull()))
    return pred.select(*keep, F.inline(rows))


def complete_windows(masked: DataFrame, fits: DataFrame, method: str) -> DataFrame:
    """Whole windows with the gaps filled by one method and the observed values unchanged."""
    keys = [c for c in CELL if c in masked.columns] + ["well", "start", "t"]
    pred = predict(masked, fits, [method]).select(*keys, *[f"p_{method}_{c}" for c in COLS])
    return masked.join(pred, keys, "left").select(
        *keys, *[F.coalesce(f"x_{c}", f"p_{method}_{c}").alias(c) for c in COLS])


class PandasImputer:
    """Adapter for user models with ``fit``/``impute`` on arrays, run one window batch at a time.

    ``model`` is a picklable, already fitted object whose ``impute(z)`` takes an
    (N, T, C) array with NaN at the gaps.  Windows are independent, so Spark hands each
    task batches of whole windows, never a whole well.
    """

    def __init__(self, model: object, size: int, name: str = "custom"):
        self.model, self.size, self.name = model, size, name

    def transform(self, masked: DataFrame, fits: DataFrame) -> DataFrame:
        """Rows (cell keys, well, start, t, p_<name>_<log>)."""
        keys = [c for c in CELL if c in masked.columns] + ["well", "start"]
        z = masked.join(fits, "well")
        packed = z.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
            "t", *[((F.col(f"x_{c}") - F.col(f"mu_{c}")) / F.col(f"sd_{c}")).alias(c) for c in COLS]))).alias("rows"),
            *[F.first(f"{k}_{c}").alias(f"{k}_{c}") for c in COLS for k in ("mu", "sd")])
        model, size = self.model, self.size
        out = T.StructType([packed.schema[k] for k in keys] + [T.StructField("t", T.IntegerType())]
                           + [T.StructField(f"p_{self.name}_{c}", T.DoubleType()) for c in COLS])
        name = self.name

        def run(frames):
            for pdf in frames:
                if not len(pdf):
                    continue
                x = np.array([[[np.nan if r[c] is None else r[c] for c in COLS] for r in rows] for rows in pdf["rows"]], float)
                y = np.asarray(model.impute(x), float)
                n = len(pdf)
                flat = {k: np.repeat(pdf[k].to_numpy(), size) for k in keys}
                flat["t"] = np.tile(np.arange(size, dtype="int32"), n)
                for i, c in enumerate(COLS):
                    mu, sd = (np.repeat(pdf[f"{k}_{c}"].to_numpy(), size) for k in ("mu", "sd"))
                    flat[f"p_{name}_{c}"] = y[:, :, i].reshape(-1) * sd + mu
                yield pd.DataFrame(flat)

        return packed.mapInPandas(run, out)

