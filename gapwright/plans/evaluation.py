"""Leave-one-well-out evaluation of within-window imputers as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SCENARIOS, STRIDE, WINDOW
from ..operators.cleaning import COLS
from ..operators.imputers import predict, predict_runs, run_moments, run_sums, to_points
from ..operators.masking import apply_masks, mask_specs
from ..operators.metrics import fold_mean_r2, fold_mean_r2_of_moments, point_metrics, point_metrics_of_moments, stats_from_predictions, stats_from_sums
from ..operators.scaling import fold_fits, fold_moments, leave_one_out, moment_sums, moments_of_blocks, well_moments
from ..operators.windows import blocks, sample_arrays, window_arrays, window_samples
from ..session import settled


def predictions(samples: DataFrame, methods: Sequence[str], scenarios: Sequence[str] = SCENARIOS,
                mask_seeds: Sequence[int] = (0,), size: int = WINDOW, stride: int = STRIDE, **kw) -> DataFrame:
    """Masked window positions with one prediction column per (method, log).

    The held-out well of a fold is the row's own well; its training statistics are the
    leave-one-out moments.  Masks depend only on (well, start, scenario, mask seed), so
    every method is scored on identical positions.  A window is one row of arrays, a mask one row of runs; the fits are
    attached to narrow (well, start) rows first, so no wide row is ever partitioned by its well alone.
    """
    if size % stride == 0:
        return predict_runs(_specs(samples, methods, scenarios, mask_seeds, size, stride, **kw), methods, size)
    fits = fold_fits(fold_moments(samples, size, stride), tuple(methods))
    masked = apply_masks(window_samples(samples, size, stride), scenarios, mask_seeds, size, **kw)
    return predict(masked, fits, methods)


def _specs(samples: DataFrame, methods: Sequence[str], scenarios: Sequence[str], mask_seeds: Sequence[int], size: int,
           stride: int, **kw) -> DataFrame:
    """Masks of every intact window with its arrays and the fits of its fold.

    The join is merged in the partitions of the windows: broadcasting either side would leave the work on all masks to the
    few tasks of the narrow rows.
    """
    return _specs_of(stored_blocks(samples, stride), methods, scenarios, mask_seeds, size, stride, **kw)


def stored_blocks(samples: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Samples and moments of every whole block, stored once for the windows and the fits."""
    return settled(blocks(samples.select("well", "idx", *COLS), [sample_arrays(), *moment_sums()], stride))


def _specs_of(rows: DataFrame, methods: Sequence[str], scenarios: Sequence[str], mask_seeds: Sequence[int], size: int, stride: int,
              **kw) -> DataFrame:
    moments = moments_of_blocks(rows, size, stride)
    fits = fold_fits(leave_one_out(well_moments(moments)), tuple(methods))
    per_window = moments.select("well", "start").join(fits, "well")
    windows = window_arrays(rows, size, stride).join(per_window.hint("merge"), ["well", "start"])
    return mask_specs(windows, scenarios, mask_seeds, size, **kw)


def _init(df: DataFrame, init_seeds: Sequence[int] | None) -> DataFrame:
    """Attach the init seed: coupled to the mask seed, or every seed of a decoupled design."""
    if init_seeds is None:
        return df.withColumn("init_seed", F.col("mask_seed"))
    return df.withColumn("init_seed", F.explode(F.array(*[F.lit(int(s)) for s in init_seeds])))


def evaluate(samples: DataFrame, methods: Sequence[str], scenarios: Sequence[str] = SCENARIOS,
             mask_seeds: Sequence[int] = (0,), init_seeds: Sequence[int] | None = None,
             size: int = WINDOW, stride: int = STRIDE, **kw) -> DataFrame:
    """Scored points (method, init_seed, mask_seed, scenario, log, well, start, t, pred, truth)."""
    pred = predictions(samples, methods, scenarios, mask_seeds, size, stride, **kw)
    return _init(to_points(pred, methods, ["mask_seed", "scenario", "well", "start", "t"]), init_seeds)


def evaluate_stats(samples: DataFrame, methods: Sequence[str], scenarios: Sequence[str] = SCENARIOS,
                   mask_seeds: Sequence[int] = (0,), init_seeds: Sequence[int] | None = None,
                   size: int = WINDOW, stride: int = STRIDE, **kw) -> DataFrame:
    """Per-well sufficient statistics of an evaluation; points are never materialised."""
    keys = ["mask_seed", "scenario", "well"]
    if size % stride == 0:
        parts = run_sums(_specs(samples, methods, scenarios, mask_seeds, size, stride, **kw), methods, size)
        return _init(stats_from_sums(parts, methods, keys), init_seeds)
    pred = predictions(samples, methods, scenarios, mask_seeds, size, stride, **kw)
    return _init(stats_from_predictions(pred, methods, keys), init_seeds)


def evaluate_metrics(samples: DataFrame, methods: Sequence[str], keys: Sequence[str] = ("method", "scenario"), scenarios: Sequence[str] = SCENARIOS,
                     mask_seeds: Sequence[int] = (0,), size: int = WINDOW, stride: int = STRIDE, **kw) -> DataFrame:
    """Point metrics of an evaluation per log and over all logs; points are never materialised."""
    if size % stride:
        return point_metrics(evaluate(samples, methods, scenarios, mask_seeds, None, size, stride, **kw), keys)
    specs = _specs(samples, methods, scenarios, mask_seeds, size, stride, **kw)
    return point_metrics_of_moments(run_moments(specs, methods, size, [k for k in keys if k != "method"]), keys)


def evaluate_fold_mean(samples: DataFrame, methods: Sequence[str], keys: Sequence[str] = ("method", "scenario", "log"), scenarios: Sequence[str] = SCENARIOS,
                       mask_seeds: Sequence[int] = (0,), size: int = WINDOW, stride: int = STRIDE, **kw) -> DataFrame:
    """Pooled R2 beside the mean of the per-fold R2 of an evaluation; points are never materialised."""
    if size % stride:
        return fold_mean_r2(evaluate(samples, methods, scenarios, mask_seeds, None, size, stride, **kw), keys)
    specs = _specs(samples, methods, scenarios, mask_seeds, size, stride, **kw)
    return fold_mean_r2_of_moments(run_moments(specs, methods, size, [*[k for k in keys if k not in ("method", "log")], "well"]), keys)


def alignment(samples: DataFrame, a: str, b: str, scenarios: Sequence[str] = SCENARIOS, mask_seeds: Sequence[int] = (0,),
              size: int = WINDOW, stride: int = STRIDE, tol: float = 1e-3) -> DataFrame:
    """Per scenario: points of method ``a`` and positions scored by one method only or with differing truth.

    Each method's masks are planned on its own and meet as one row per window and mask, with the masked positions and the truth
    there as arrays.  ``size`` is a multiple of ``stride``.
    """
    rows = stored_blocks(samples, stride)
    keys = ["scenario", "mask_seed", "well", "start"]

    def side(method: str, s: str) -> DataFrame:
        specs = _specs_of(rows, [method], scenarios, mask_seeds, size, stride)
        return specs.select(*keys, F.col("mask_bits").alias(f"{s}_bits"), F.expr("flatten(transform(runs, r -> sequence(r.a, r.b - 1)))").alias(f"{s}_t"),
                            *[F.expr(f"flatten(transform(runs, r -> slice(a_{c}, r.a + 1, r.b - r.a)))").alias(f"{s}_{c}") for c in COLS])

    both = side(a, "a").join(side(b, "b").hint("merge"), keys, "full")
    n, bad = [], []
    for i, c in enumerate(COLS):
        hit = {s: f"coalesce({s}_bits & {1 << i}, 0) > 0" for s in "ab"}
        at = {s: f"if({hit[s]}, {s}_t, CAST(array() AS array<int>))" for s in "ab"}
        off = "x IS NULL OR y IS NULL OR abs(x - y) > {}D".format(tol)
        same = f"size(filter(zip_with(a_{c}, b_{c}, (x, y) -> {off}), v -> v))"
        none = "CAST(array() AS array<double>)"
        pairs = ", ".join(f"map_from_arrays({at[s]}, if({hit[s]}, {s}_{c}, {none}))" for s in "ab")
        apart = f"size(map_filter(map_zip_with({pairs}, (t, x, y) -> {off}), (t, v) -> v))"
        n.append(f"size({at['a']})")
        bad.append(f"CASE WHEN NOT ({hit['a']}) AND NOT ({hit['b']}) THEN 0 WHEN {hit['a']} AND {hit['b']} AND a_t = b_t THEN {same} ELSE {apart} END")
    return both.groupBy("scenario").agg(F.sum(F.expr(" + ".join(n)).cast("long")).alias("n"), F.sum(F.expr(" + ".join(bad)).cast("long")).alias("bad"))
