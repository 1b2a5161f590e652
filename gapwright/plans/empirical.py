"""Empirical whole-well blackout: observed gap shapes imposed on intact segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import EMPIRICAL, LOGS, STRIDE, WINDOW
from ..functions.ordered import CHUNK, chain_ends
from ..operators.cleaning import COLS
from ..operators.imputers import NATIVE, SEQUENTIAL, add_slopes, points_of_runs, sums_of_runs
from ..operators.masking import empirical_masks, interval_catalogue
from ..operators.metrics import stats_from_sums
from ..operators.missingness import code_runs, intact_segments, intervals
from ..operators.scaling import CENTRE, MOMENTS, PAIRS, fold_fits, fold_moments, leave_one_out, moments_of_blocks, well_moments
from ..session import cut_lineage

#: samples of a piece, the row of arrays this module works on; a multiple of the stride
PIECE = 1_024
ENDS = ("y", "t", "oy", "ot")
MASK = ["well", "seg_start", "rep", "mask_seed"]


def plan_masks(samples: DataFrame, reps: int = 5, mask_seed: int = 0, size: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """Masks drawn from the data's own intervals over its own intact segments."""
    runs = code_runs(samples)
    return empirical_masks(intact_segments(runs, size, chunk), interval_catalogue(intervals(runs, chunk)), reps, mask_seed)


def pieces(samples: DataFrame) -> DataFrame:
    """Samples as one row of arrays per well and ``PIECE`` positions: (well, piece, at, a_<log>), stored once."""
    rows = samples.groupBy("well", F.expr(f"idx div {PIECE}").alias("piece")).agg(F.sort_array(F.collect_list(F.struct("idx", *COLS))).alias("rows"))
    return cut_lineage(rows.select("well", "piece", F.col("rows.idx").alias("at"), *[F.col(f"rows.{c}").alias(f"a_{c}") for c in COLS]))


def digest(rows: DataFrame, stride: int = STRIDE) -> DataFrame:
    """What the plan needs of each piece, stored: runs of a constant absent set, moments of whole blocks, outermost two samples of each log.

    The outermost samples are ``f_<k>_<log>`` (first ones) and ``l_<k>_<log>`` (last ones), ``k`` as in ``ENDS``.
    """
    moments = MOMENTS[1:]
    ends = [f"{side}_{k}_{c}" for side in "fl" for c in COLS for k in ENDS]
    schema = T.StructType([rows.schema["well"], rows.schema["piece"],
                           *T._parse_datatype_string("runs array<struct<code:int,start:bigint,end:bigint>>, blocks array<struct<blk:bigint,"
                                                     + ",".join(f"{m}:double" for m in moments) + ">>").fields,
                           *[T.StructField(e, T.DoubleType()) for e in ends]])

    def work(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            row, lo, hi, at, value, ok = _flat(rb)
            n = len(row)
            code = sum(np.where(ok[c], 0, 1 << i) for i, c in enumerate(COLS))
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
            last = np.r_[first[1:], n] - 1
            out = {"well": rb.column("well"), "piece": rb.column("piece")}
            out["runs"] = _lists(row[first], rb.num_rows, {"code": code[first].astype("int32"), "start": at[first], "end": at[last] + 1})
            use = np.flatnonzero((code == 0) & (at >= 0))
            blk, of = at[use] // stride, row[use]
            head = np.r_[True, (blk[1:] != blk[:-1]) | (of[1:] != of[:-1])] if len(use) else np.zeros(0, bool)
            g = np.cumsum(head) - 1
            whole = np.bincount(g, minlength=0) == stride if len(use) else np.zeros(0, bool)
            z = {c: value[c][use] - CENTRE[c] for c in COLS}
            sums = {**{f"s_{c}": z[c] for c in COLS}, **{f"q_{a}_{b}": z[a] * z[b] for a, b in PAIRS}}
            out["blocks"] = _lists(of[head][whole], rb.num_rows, {"blk": blk[head][whole], **{
                m: np.bincount(g, weights=sums[m]).astype(float)[whole] if len(use) else np.zeros(0) for m in moments}})
            none = np.full(rb.num_rows, np.nan)
            for side, pos, edge in (("f", lo - 1, hi), ("l", hi, lo)):
                for c in COLS:
                    got = _two(ok[c], value[c], at, pos, edge, (none, none), (none, none), side == "l")
                    out.update({f"{side}_{k}_{c}": _nullable(v) for k, v in zip(ENDS, got)})
            yield from pa.table({f.name: out[f.name] for f in schema}).to_batches()

    return cut_lineage(rows.mapInArrow(work, schema))


def _flat(rb: pa.RecordBatch):
    """The pieces of a batch end to end: row of each sample, first and past-the-end sample of each row, positions, values, measured."""
    length = np.diff(rb.column("at").offsets.to_numpy())
    hi = np.cumsum(length)
    flat = {c: rb.column(f"a_{c}").flatten() for c in COLS}
    return (np.repeat(np.arange(rb.num_rows), length), hi - length, hi, rb.column("at").flatten().to_numpy(),
            {c: v.to_numpy(zero_copy_only=False) for c, v in flat.items()}, {c: v.is_valid().to_numpy(zero_copy_only=False) for c, v in flat.items()})


def _lists(row: np.ndarray, n: int, fields: dict[str, np.ndarray]) -> pa.Array:
    """Structs grouped into one list per row; ``row`` does not decrease."""
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))


def _nullable(v: np.ndarray) -> pa.Array:
    return pa.array(v, type=pa.float64(), from_pandas=True)


def _two(ok, y, t, pos, edge, near, far, forward: bool):
    """Value and position of the two nearest measured samples before ``pos`` (after it, if not ``forward``) down to ``edge``.

    ``near`` and ``far`` are the (value, position) pairs that lie outside the piece, nearest first.
    """
    n = len(ok)
    if forward:
        seen = np.r_[-1, np.maximum.accumulate(np.where(ok, np.arange(n), -1))]
        step, valid = (lambda i: seen[np.maximum(i, 0)]), (lambda i: i >= edge)
    else:
        seen = np.r_[np.minimum.accumulate(np.where(ok, np.arange(n), n)[::-1])[::-1], n]
        step, valid = (lambda i: seen[np.minimum(i + 1, n)]), (lambda i: i < edge)
    i = step(pos)
    one = valid(i)
    j = step(i)
    two = one & valid(j)
    i, j = np.clip(i, 0, n - 1), np.clip(j, 0, n - 1)
    return (np.where(one, y[i], near[0]), np.where(one, t[i], near[1]),
            np.where(two, y[j], np.where(one, near[0], far[0])), np.where(two, t[j], np.where(one, near[1], far[1])))


def _outside(marks: DataFrame) -> DataFrame:
    """Per piece the two measured samples of each log nearest to it on both sides: ``b<k>_<log>`` before, ``a<k>_<log>`` after."""
    out = None
    for side, own, forward in (("b", "l", True), ("a", "f", False)):
        ends = marks.select("well", "piece", *[F.col(f"{own}_{k}_{c}").alias(f"_{k}_{c}") for c in COLS for k in ENDS])
        ends = chain_ends(ends, ["well"], "piece", COLS, forward)
        ends = ends.select("well", "piece", *[F.col(f"_{old}_{c}").alias(f"{side}{k}_{c}") for c in COLS
                                              for k, old in (("y", "py"), ("t", "pt"), ("oy", "qy"), ("ot", "qt"))])
        out = ends if out is None else out.join(ends, ["well", "piece"])
    return out


def _planned(marks: DataFrame, reps: int, mask_seed: int, size: int) -> DataFrame:
    """:func:`plan_masks` from the runs of the pieces, stored."""
    runs = marks.select("well", F.col("piece").alias("chunk"), F.inline("runs"))
    return cut_lineage(empirical_masks(intact_segments(runs, size, PIECE), interval_catalogue(intervals(runs, PIECE)), reps, mask_seed))


def _knots(rows: DataFrame, marks: DataFrame, masks: DataFrame) -> DataFrame:
    """Masks with the two nearest measured samples of the well on both sides: ``b<k>_<log>`` and ``a<k>_<log>``.

    One interval is hidden at a time, so these are lookups at its ends.  Masks with an end on no sample are dropped.
    """
    edges = masks.select("well", F.inline(F.array(*[
        F.struct(F.expr(f"({pos}) div {PIECE}").alias("piece"), F.struct(*MASK[1:], F.expr(pos).alias("pos"), F.lit(side).alias("above")).alias("e"))
        for pos, side in (("mask_from", True), ("mask_to - 1", False))])))
    edges = edges.groupBy("well", "piece").agg(F.collect_list("e").alias("e"))
    names = [f"{side}{k}_{c}" for side in "ba" for c in COLS for k in ENDS]
    df = rows.join(edges, ["well", "piece"]).join(_outside(marks), ["well", "piece"])
    keys = [rows.schema["well"], *[masks.schema[k] for k in MASK[1:]]]
    schema = T.StructType([*keys, T.StructField("above", T.BooleanType()), *[T.StructField(k, T.DoubleType()) for k in names]])

    def work(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            row, lo, hi, at, value, ok = _flat(rb)
            e = rb.column("e")
            r = np.repeat(np.arange(rb.num_rows), np.diff(e.offsets.to_numpy()))
            e = e.flatten()
            want, above = e.field("pos").to_numpy(), e.field("above").to_numpy(zero_copy_only=False)
            base = rb.column("piece").to_numpy() * PIECE
            key, ask = row * PIECE + at - base[row], r * PIECE + want - base[r]
            pos = np.minimum(np.searchsorted(key, ask), len(key) - 1)
            for side in "ba":
                use = np.flatnonzero((key[pos] == ask) & (above == (side == "b")))
                if not len(use):
                    continue
                out = {"well": rb.column("well").take(pa.array(r[use]))}
                out.update({k: e.field(k).take(pa.array(use)) for k in MASK[1:]})
                out["above"] = above[use]
                out.update({k: pa.nulls(len(use), pa.float64()) for k in names})
                out.update(_reach(rb, r[use], pos[use], (lo if side == "b" else hi)[r[use]], side, ok, value, at))
                yield from pa.table({f.name: out[f.name] for f in schema}).to_batches()

    found = df.mapInArrow(work, schema).groupBy(*MASK).agg(F.count_if("above").alias("_b"), F.count_if(~F.col("above")).alias("_a"),
                                                           *[F.max(k).alias(k) for k in names])
    return masks.join(found.where("_a > 0 AND _b > 0").drop("_a", "_b"), MASK)


def _reach(rb: pa.RecordBatch, r, pos, edge, side: str, ok, value, at) -> dict[str, pa.Array]:
    """The knots on one side of sample ``pos`` of the rows ``r``, taken from outside the piece where it holds none."""
    out = {}
    for c in COLS:
        far = {k: rb.column(f"{side}{k}_{c}").to_numpy(zero_copy_only=False)[r] for k in ENDS}
        got = _two(ok[c], value[c], at, pos, edge, (far["y"], far["t"]), (far["oy"], far["ot"]), side == "b")
        out.update({f"{side}{k}_{c}": _nullable(v) for k, v in zip(ENDS, got)})
    return out


def _tiled_locf(size: int):
    """Carry-forward inside half-overlapping windows of the segment, averaged over the windows that cover a position.

    All of a segment but the masked interval is measured: a window that starts above the interval carries the sample before
    it, one that starts inside knows nothing above and takes the fold mean.
    """
    step = size // 2

    def guess(col, c, mu, r, idx):
        start = col("seg_start")[r].astype("int64")
        x, f, last = idx - start, col("mask_from")[r].astype("int64") - start, col("seg_end")[r].astype("int64") - start - size
        low, high = np.maximum(0, -((size - 1 - x) // step)), np.minimum(last // step, x // step)
        flush = (last % step != 0) & (x >= last)
        cover = high - low + 1 + flush
        seen = np.maximum(0, np.minimum(high, (f - 1) // step) - low + 1) + (flush & (last < f))
        return (seen * np.where(seen > 0, col(f"by_{c}")[r], 0.0) + (cover - seen) * mu[r]) / cover

    return {"locf_win": guess}


def empirical_runs(samples: DataFrame, methods: Sequence[str], reps: int = 5, mask_seed: int = 0, size: int = WINDOW) -> DataFrame:
    """One row per mask and piece it lies in, as :func:`gapwright.operators.imputers.sums_of_runs` reads them.

    Carry-forward and interpolation see the whole well around an interval; mean, ridge and chained predictions depend on the
    position alone, so the average over windows leaves them as they are.
    """
    unknown = set(methods) - set(NATIVE)
    if unknown:
        raise ValueError(f"not a window imputer: {sorted(unknown)}")
    rows = pieces(samples)
    marks = digest(rows)
    moments = fold_moments(samples, size) if size % STRIDE else leave_one_out(well_moments(moments_of_blocks(marks.select("well", F.inline("blocks")), size)))
    masks = _planned(marks, reps, mask_seed, size)
    if set(methods) & set(SEQUENTIAL):
        masks = _knots(rows, marks, masks)
        if "interp_pchip" in methods:
            masks = add_slopes(masks)               # slopes belong to the interval, not to its positions
    masks = masks.join(fold_fits(moments, tuple(methods)), "well").withColumnRenamed("mask_cols", "mask_bits")
    parts = masks.withColumn("piece", F.explode(F.expr(f"sequence(mask_from div {PIECE}, (mask_to - 1) div {PIECE})"))).join(rows, ["well", "piece"])
    # where positions are missing between samples the stretch is counted, else it follows from the first position
    dense = "at[size(at) - 1] - at[0] + 1 = size(at)"
    low = f"CASE WHEN {dense} THEN greatest(mask_from - at[0], 0) ELSE size(filter(at, x -> x < mask_from)) END"
    high = f"CASE WHEN {dense} THEN least(mask_to - at[0], size(at)) ELSE size(filter(at, x -> x < mask_to)) END"
    parts = parts.withColumn("_lo", F.expr(low).cast("int")).withColumn("_hi", F.expr(high).cast("int")).where("_hi > _lo")
    cut = [F.slice(a, F.col("_lo") + 1, F.col("_hi") - F.col("_lo")).alias(v) for a, v in (("at", "v_t"), *[(f"a_{c}", f"v_{c}") for c in COLS])]
    return parts.select(*[c for c in masks.columns], F.col("mask_from").alias("a"), *cut)


def evaluate_empirical(samples: DataFrame, methods: Sequence[str], reps: int = 5, mask_seed: int = 0, size: int = WINDOW) -> DataFrame:
    """Scored points of the empirical scenario; carry-forward and interpolation see the full well, ``locf_win`` its windows."""
    pts = points_of_runs(empirical_runs(samples, methods, reps, mask_seed, size), methods, ["mask_seed", "rep", "well", "seg_start"], "idx", _tiled_locf(size))
    return pts.withColumn("scenario", F.lit(EMPIRICAL)).withColumn("init_seed", F.col("mask_seed"))


def empirical_stats(samples: DataFrame, methods: Sequence[str], reps: int = 5, mask_seed: int = 0, size: int = WINDOW) -> DataFrame:
    """Sufficient statistics per (method, log, well) of the empirical scenario; points are never materialised."""
    parts = sums_of_runs(empirical_runs(samples, methods, reps, mask_seed, size), methods, ["well"], _tiled_locf(size))
    return stats_from_sums(parts, methods, ["well"])


def fill_well(samples: DataFrame, method: str, fits: DataFrame) -> DataFrame:
    """Natural gaps of every well filled by carry-forward, linear or shape-preserving cubic interpolation.

    Beyond the outermost samples interpolation is constant; the cubic needs three samples of a log and is linear below.
    A log without samples takes the mean of ``fits``.
    """
    if method not in ("locf", "interp_linear", "interp_pchip"):
        raise ValueError(method)
    rows = pieces(samples)
    df = rows.join(_outside(digest(rows)), ["well", "piece"]).join(fits.select("well", *[f"mu_{c}" for c in COLS]), "well", "left")
    schema = T.StructType([samples.schema["well"], T.StructField("idx", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in COLS]])

    def work(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            row, lo, hi, at, value, ok = _flat(rb)
            out = {"well": rb.column("well").take(pa.array(row)), "idx": pa.array(at)}
            for c in COLS:
                gap = np.flatnonzero(~ok[c])
                r, full, known = row[gap], value[c].astype(float), ok[c].copy()
                ends = {}
                for side, edge in (("b", lo), ("a", hi)):
                    far = {k: rb.column(f"{side}{k}_{c}").to_numpy(zero_copy_only=False).astype(float)[r] for k in ENDS}
                    ends[side] = _two(ok[c], full, at, gap, edge[r], (far["y"], far["t"]), (far["oy"], far["ot"]), side == "b")
                mu = rb.column(f"mu_{c}").to_numpy(zero_copy_only=False).astype(float)[r]
                full[gap], known[gap] = _fill(method, at[gap], ends["b"], ends["a"], mu)
                out[c] = pa.array(full, mask=~known)
            yield from pa.table(out).to_batches(10_000)

    return df.mapInArrow(work, schema)


def _fill(method: str, t, before, after, mu):
    """Values at the positions ``t`` from the knots on both sides, and whether there is one; no knot position means no knot."""
    by, bt, boy, bot = before
    ay, at, aoy, aot = after
    above, below = np.isfinite(bt), np.isfinite(at)
    none = np.where(np.isfinite(mu), mu, np.nan)
    if method == "locf":
        return np.where(above, by, none), above | np.isfinite(mu)
    flat = np.where(above, by, np.where(below, ay, none))
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(above & below, by + (ay - by) * (t - bt) / (at - bt), flat)
        if method == "interp_pchip":
            h = at - bt
            hl, hr, mm = bt - bot, aot - at, (ay - by) / h
            ml, mr = (by - boy) / hl, (aoy - ay) / hr
            db, da = (_slope(h, mm, hs, ms, ho, mo) for hs, ms, ho, mo in ((hl, ml, hr, mr), (hr, mr, hl, ml)))
            s = (t - bt) / h
            cubic = ((1 + 2 * s) * (1 - s) * (1 - s) * by + s * (1 - s) * (1 - s) * h * db + s * s * (3 - 2 * s) * ay + s * s * (s - 1) * h * da)
            curved = above & below & (np.isfinite(bot) | np.isfinite(aot))
            out = np.where(curved, cubic, out)
    return out, above | below | np.isfinite(mu)


def _slope(h, m, hs, ms, ho, mo):
    """Shape-preserving slope at a knot: ``hs, ms`` lie on its own side, ``ho, mo`` beyond the other knot (see ``add_slopes``)."""
    w0, w1 = 2 * h + hs, h + 2 * hs
    inner = np.where(ms * m <= 0, 0.0, (w0 + w1) / (w0 / ms + w1 / m))
    d = ((2 * h + ho) * m - h * mo) / (h + ho)
    outer = np.where(np.sign(d) != np.sign(m), 0.0, np.where((np.sign(m) != np.sign(mo)) & (np.abs(d) > 3 * np.abs(m)), 3 * m, d))
    return np.where(np.isfinite(hs), inner, outer)


__all__ = ["plan_masks", "pieces", "digest", "empirical_runs", "empirical_stats", "evaluate_empirical", "fill_well", "LOGS"]
