"""Split and leakage experiments: who may train on what."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SCENARIOS, STRIDE, WINDOW
from ..operators.imputers import predict, run_moments, to_points
from ..operators.masking import _with_scalar, apply_masks, mask_specs, subsample, window_split
from ..operators.metrics import macro_r2, metric_columns, metrics_of_moments, point_metrics_of_moments, sufficient_stats
from ..operators.scaling import MOMENTS, SCALER, moments_of_blocks, window_moments, with_ridge, with_scaler
from ..operators.windows import window_arrays, window_samples
from ..operators.scaling import others
from ..operators.cleaning import COLS
from ..operators.spatial import grid_offsets, on_grid, spatial_points
from ..session import cut_lineage, released
from .evaluation import stored_blocks

#: configuration C: the training windows of B, the test windows' depths blanked in the neighbour grid
BLANKED = "C_window_no_overlap_blanked"


def overlapping(windows: DataFrame, test: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Windows without any sample shared with a test window of the same well.

    Starts lie on the stride, so a test window rules out a fixed, short list of starts:
    an equi anti-join on (well, start), no range join.
    """
    reach = (size - 1) // stride
    banned = test.select("well", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_k"), F.col("start").alias("_s"))
    banned = banned.select("well", (F.col("_s") + F.col("_k") * stride).alias("start")).distinct()
    return windows.join(banned, ["well", "start"], "left_anti")


def train_sets(windows: DataFrame, seed: int = 0, test_frac: float = 0.2) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Test windows and the training windows of configurations A and B."""
    split = cut_lineage(window_split(windows, seed, test_frac))
    test = split.where("is_test").select("well", "start")
    a = split.where("NOT is_test").select("well", "start")
    return test, {"A_window_overlap": a, "B_window_no_overlap": overlapping(a, test)}


def matched_counts(windows: DataFrame, test: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """Size of each training set, the smallest well-split set included, and the matched size."""
    parts = [s.agg(F.count(F.lit(1)).alias("n")).withColumn("config", F.lit(k)) for k, s in sets.items()]
    per = windows.groupBy("well").agg(F.count(F.lit(1)).alias("_w")).join(test.select("well").distinct(), "well", "left_semi")
    d = _with_scalar(per, windows.agg(F.count(F.lit(1)).alias("_n"))).agg(F.min(F.col("_n") - F.col("_w")).alias("n"))
    parts.append(d.withColumn("config", F.lit("D_well_split")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.agg(F.min("n").alias("n_match"))
    return _with_scalar(out, best).select("config", "n", "n_match")


def global_fits(moments: DataFrame) -> DataFrame:
    """Scaler and ridge weights of one shared training set (no fold)."""
    total = moments.agg(*[F.sum(m).alias(m) for m in MOMENTS])
    cols = [*SCALER, *[f"w_{c}_{o}" for c in COLS for o in others(c)]]
    return with_ridge(with_scaler(total)).select(*cols)


def _masked_windows(rows: DataFrame, test: DataFrame, fits: DataFrame, scenarios: Sequence[str], mask_seeds: Sequence[int],
                    size: int, stride: int, **kw) -> DataFrame:
    """Masks of the test windows with their arrays and the fits of their well; the fits meet narrow (well, start) rows."""
    per_window = test.join(fits, "well")
    return mask_specs(window_arrays(rows, size, stride).join(per_window.hint("merge"), ["well", "start"]), scenarios, mask_seeds, size, **kw)


def matched_experiment(samples: DataFrame, windows: DataFrame | None = None, method: str = "ridge", seed: int = 0,
                       test_frac: float = 0.2, scenarios: Sequence[str] = ("single", "block", "profile", "blackout"),
                       size: int = WINDOW, stride: int = STRIDE, coords: DataFrame | None = None, spatial: Sequence[str] = ("nnwell",)) -> DataFrame:
    """Per-log R2 of one trained method, and of methods that read the neighbour grid, under configurations A, B, C and D.

    All configurations score the same test windows under the same masks and train on the
    same number of windows.  A shares wells and samples, B shares wells only, C is B with the
    test windows' depths blanked in the neighbour grid, D trains without the scored well.
    Without ``coords`` there is no neighbour grid: the ``spatial`` methods and C, which differs
    from B in the grid, are left out.  Without ``windows`` every intact window takes part.
    """
    rows = stored_blocks(samples, stride) if size % stride == 0 else None
    wm = cut_lineage(window_moments(samples, size, stride) if rows is None else moments_of_blocks(rows, size, stride))
    test, sets = train_sets(wm.select("well", "start") if windows is None else windows, seed, test_frac)
    n_match = cut_lineage(matched_counts(wm.select("well", "start"), test, sets).agg(F.min("n_match").alias("n_match")))
    wells = test.select("well").distinct()
    if coords is not None:
        sets[BLANKED] = sets["B_window_no_overlap"]       # of one size, so it does not change the matched one
    fits = _well_split_fits(wm, wells, n_match, seed + 9).withColumn("config", F.lit("D_well_split"))
    for i, (name, train) in enumerate(sets.items()):
        pool = _take(train, n_match, seed + 1 + i)
        shared = _with_scalar(wells, global_fits(wm.join(pool, ["well", "start"], "left_semi")))
        fits = fits.unionByName(shared.withColumn("config", F.lit(name)))
    fits, keys = cut_lineage(fits), ["scenario", "config"]
    if rows is not None:
        parts = cut_lineage(run_moments(_masked_windows(rows, test, fits, scenarios, (0,), size, stride), [method], size, keys))
        out = metrics_of_moments(parts, ["method", "scenario", "log", "config"])
    else:
        ws = window_samples(samples, size, stride).join(test, ["well", "start"], "left_semi")
        # one pass over the masked windows: every position meets the fits of all configurations
        pred = predict(apply_masks(ws, scenarios, (0,), size), fits, [method])
        out = to_points(pred, [method], keys).groupBy("method", "scenario", "log", "config").agg(*metric_columns())
    out = out.select("method", "scenario", "log", "config", "n", "r2")
    if coords is not None:
        for part in _grid_scores(samples, test, fits, coords, spatial, scenarios, size, stride):
            out = out.unionByName(part)
    return out


def _grid_scores(samples: DataFrame, test: DataFrame, fits: DataFrame, coords: DataFrame, kinds: Sequence[str], scenarios: Sequence[str],
                 size: int, stride: int) -> list[DataFrame]:
    """Scores of the methods that read the neighbour grid: whole for all configurations but C, without the test windows' depths for C.

    Starts lie on the stride, so a test window is a short list of blocks: an equi-join on (well, block), no range join.
    """
    released(samples.sparkSession)
    unit = gcd(size, stride)
    tested = test.select("well", F.explode(F.expr(f"sequence(start div {unit}, (start + {size - 1}) div {unit})")).alias("_blk")).distinct()
    marked = samples.withColumn("_blk", F.expr(f"idx div {unit}")).join(tested.withColumn("_t", F.lit(True)), ["well", "_blk"], "left")
    off = cut_lineage(grid_offsets(samples))
    grid = on_grid(marked, off, F.coalesce("_t", F.lit(False)).alias("hidden"))
    out = []
    for kind in kinds:
        for blank in (False, True):
            own = fits.where((F.col("config") == BLANKED) == blank).select("well", "config", *SCALER)
            specs = mask_specs(test.join(own, "well"), scenarios, (0,), size)
            points = spatial_points(specs, grid, coords, off, kind, ["scenario", "config"], told=True, hide=blank)
            scores = points.groupBy("method", "scenario", "log", "config").agg(*metric_columns())
            out.append(cut_lineage(scores.select("method", "scenario", "log", "config", "n", "r2")))
            released(samples.sparkSession)
    return out


def _take(train: DataFrame, n_match: DataFrame, seed: int) -> DataFrame:
    from ..operators.masking import SALT_SPLIT, shuffled
    pos = _with_scalar(shuffled(train, seed, SALT_SPLIT + 1), n_match)
    return pos.where("pos < n_match").select("well", "start")


def _well_split_fits(wm: DataFrame, wells: DataFrame, n_match: DataFrame, seed: int) -> DataFrame:
    """Leave-one-well-out fits on a matched number of windows, without a train set per well.

    Windows get one random order.  The first n_match windows outside a well end at position
    n_match + (own windows before that point), so a fold's moments are a prefix of the
    order minus the well's own part of it; prefixes differ by at most one well's windows.
    """
    from ..operators.masking import SALT_SPLIT, shuffled
    order = shuffled(wm.select("well", "start"), seed, SALT_SPLIT + 2).select("well", "start", "pos")
    pos = cut_lineage(order.join(wm, ["well", "start"]))
    own = pos.join(wells, "well", "left_semi").select("well", "pos")
    from ..functions.ordered import CHUNK, ordinal
    ranked = ordinal(own.withColumn("_slab", F.expr(f"pos div {CHUNK}")), ["well"], "_slab", ["pos"], "own_rank")
    # the j-th own window (rank j, position p) lies inside the prefix iff p - j < n_match + ... its
    # position among foreign windows, p - j, is below n_match
    inside = _with_scalar(ranked, n_match).where(F.col("pos") - F.col("own_rank") < F.col("n_match"))
    cut = inside.groupBy("well").agg(F.count(F.lit(1)).alias("own_in"))
    cuts = _with_scalar(wells.join(cut, "well", "left"), n_match).select(
        "well", (F.col("n_match") + F.coalesce("own_in", F.lit(0))).alias("cut"))
    return _prefix_fits(pos, cuts)


def _prefix_fits(pos: DataFrame, cuts: DataFrame) -> DataFrame:
    """Moments of each prefix (by distinct cut) minus the well's own windows inside it."""
    from pyspark.sql import Window
    edges = cuts.select("cut").distinct()
    # position p belongs to the first cut above it: cumulative sums over the sorted distinct cuts
    tagged = (pos.select("pos", *MOMENTS).unionByName(
        edges.select(F.col("cut").alias("pos"), *[F.lit(0).alias(m) for m in MOMENTS]), allowMissingColumns=True))
    slab = tagged.withColumn("_slab", F.expr("pos div 1024"))
    per = slab.groupBy("_slab").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    # sums of what lies before: inside groups of 1,024 slabs, and over one row per group (a million windows each)
    inner = Window.partitionBy("_group").orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_group", F.expr("_slab div 1024"))
    ahead = per.groupBy("_group").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    ahead = ahead.select("_group", *[F.coalesce(F.sum(m).over(outer), F.lit(0.0)).alias(f"a_{m}") for m in MOMENTS])
    per = per.select("_group", "_slab", *[F.coalesce(F.sum(m).over(inner), F.lit(0.0)).alias(m) for m in MOMENTS])
    per = per.join(ahead, "_group").select("_slab", *[(F.col(m) + F.col(f"a_{m}")).alias(f"t_{m}") for m in MOMENTS])
    part = (pos.withColumn("_slab", F.expr("pos div 1024"))
            .join(edges.withColumn("_slab", F.expr("cut div 1024")), "_slab").where("pos < cut")
            .groupBy("cut").agg(*[F.sum(m).alias(f"i_{m}") for m in MOMENTS]))
    whole = (edges.withColumn("_slab", F.expr("cut div 1024")).join(per, "_slab").join(part, "cut", "left")
             .select("cut", *[(F.col(f"t_{m}") + F.coalesce(f"i_{m}", F.lit(0.0))).alias(f"t_{m}") for m in MOMENTS]))
    own = (pos.join(cuts, "well").where("pos < cut").groupBy("well").agg(*[F.sum(m).alias(f"o_{m}") for m in MOMENTS]))
    fold = cuts.join(whole, "cut").join(own, "well", "left").select(
        "well", *[(F.col(f"t_{m}") - F.coalesce(f"o_{m}", F.lit(0.0))).alias(m) for m in MOMENTS])
    cols = [*SCALER, *[f"w_{c}_{o}" for c in COLS for o in others(c)]]
    return with_ridge(with_scaler(fold)).select("well", *cols)


def leak_split_metrics(samples: DataFrame, windows: DataFrame | None = None, method: str = "ridge", seed: int = 0,
                       test_frac: float = 0.2, scenarios: Sequence[str] = SCENARIOS, mask_seeds: Sequence[int] = (0,), **kw) -> DataFrame:
    """Window-level split: one scaler and model over the training windows of all wells, then
    point metrics on the test windows.  Without ``windows`` every intact window takes part."""
    rows = stored_blocks(samples)
    wm = cut_lineage(moments_of_blocks(rows))
    test, sets = train_sets(wm.select("well", "start") if windows is None else windows, seed, test_frac)
    fits = _with_scalar(test.select("well").distinct(), global_fits(wm.join(sets["A_window_overlap"], ["well", "start"], "left_semi")))
    specs = _masked_windows(rows, test, fits, scenarios, mask_seeds, WINDOW, STRIDE, **kw)
    return point_metrics_of_moments(run_moments(specs, [method], WINDOW, ["scenario"]), ["method", "scenario"])


def leak_delta(off: DataFrame, on: DataFrame, keys: Sequence[str] = ("method", "scenario", "log")) -> DataFrame:
    """r2 with the protection on, off, and the difference."""
    a = off.select(*keys, F.col("r2").alias("r2_leak_off"))
    b = on.select(*keys, F.col("r2").alias("r2_leak_on"))
    return a.join(b, list(keys)).withColumn("delta", F.col("r2_leak_on") - F.col("r2_leak_off"))


__all__ = ["overlapping", "train_sets", "matched_counts", "matched_experiment", "leak_split_metrics", "leak_delta",
           "subsample", "macro_r2", "sufficient_stats"]
