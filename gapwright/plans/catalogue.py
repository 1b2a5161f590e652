"""Named queries over the driver tables: one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SCENARIOS
from ..operators import bootstrap as bs
from ..operators import cleaning as cl
from ..operators import imputers as im
from ..operators import masking as mk
from ..operators import metrics as mt
from ..operators import missingness as ms
from ..operators import scaling as sc
from ..operators import significance as sg
from ..operators import spatial as sp
from ..operators import windows as wn
from ..session import cut_lineage, settled, stored
from ..sources import tables as tb
from . import empirical as em
from . import leakage as lk
from . import reports as rp
from .evaluation import alignment, evaluate, evaluate_fold_mean, evaluate_metrics, evaluate_stats, predictions

METHODS = ("mean", "locf", "interp_linear", "ridge")
SEEDS = (0, 1)
PAIRS = {s: (("locf", "mean"), ("locf", "interp_linear"), ("interp_linear", "ridge"), ("ridge", "mean")) for s in SCENARIOS}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Register a query under its function name."""
    QUERIES[fn.__name__] = fn
    return fn


def rnd(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns; adding 0.0 turns a negative zero into zero."""
    return df.select(*[(F.round(c, digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(c) for c in df.columns])


def _suff(spark: SparkSession, d: str, seeds=SEEDS, methods=METHODS, init_seeds=None, samples: DataFrame | None = None) -> DataFrame:
    """Per-well statistics of the evaluation, stored once: every table below reads them repeatedly."""
    s = tb.well_samples(spark, d) if samples is None else samples
    return cut_lineage(evaluate_stats(s, methods, mask_seeds=seeds, init_seeds=init_seeds))


def _by_log(df: DataFrame, *cols: str) -> DataFrame:
    """Round sums to the precision of their channel."""
    return df.select(*[F.when(F.col("log") == "GR", F.round(c, 3)).otherwise(F.round(c, 6)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _errors(spark: SparkSession, d: str, samples: DataFrame | None = None) -> DataFrame:
    """Seed-averaged per-well error, rounded as in the published tables."""
    s = tb.well_samples(spark, d) if samples is None else samples
    sigma = mt.scaler_sigma(sc.fold_scaler(s))
    return cut_lineage(sg.seed_average(mt.nrmse_per_well(_suff(spark, d, samples=samples), sigma)).withColumn("nrmse", F.round("nrmse", 6)))


def _raw(spark: SparkSession, d: str, seeds=SEEDS, methods=METHODS) -> DataFrame:
    """Per-fold metrics with the R2 over all logs as ``r2``."""
    s = tb.well_samples(spark, d)
    per = rp.all_log_r2(_suff(spark, d, seeds, methods), [*mt.CELL, "well"])
    return cut_lineage(per.join(wn.folds(wn.intact_windows(s)).select(F.col("test_well").alias("well"), F.col("fold_id").alias("fold")), "well").select(
        F.col("mask_seed").alias("seed"), "method", "scenario", "fold", "log", F.round("r2", 6).alias("r2")))


# --- cleaning and QC -----------------------------------------------------------------------

@query
def coverage(spark, d):
    return cl.coverage(tb.well_samples(spark, d), 6)


@query
def depth_qc(spark, d):
    return rnd(cl.depth_qc(tb.event_depths(spark, d)), median_step_m=4, min_step_m=4, max_step_m=4, jump_m=2)


@query
def depth_qc_regular(spark, d):
    return rnd(cl.depth_qc(tb.well_samples(spark, d)), median_step_m=6, min_step_m=6, max_step_m=6, jump_m=2)


@query
def harmonise_actions(spark, d):
    _, actions = cl.harmonise(tb.samples_dirty(spark, d))
    return actions.select("well", "log", "n_out", F.regexp_replace("action", r"median=[0-9.]+", "median").alias("action"))


@query
def harmonised_samples(spark, d):
    clean, _ = cl.harmonise(tb.samples_dirty(spark, d))
    return rnd(clean.drop("chunk", "depth"), gr=6, rhob=6, nphi=6)


@query
def excluded_wells(spark, d):
    ev = tb.event_depths(spark, d)
    kept = cl.drop_failing(ev, cl.depth_qc(ev)).select("well").distinct().withColumn("kept", F.lit(True))
    return ev.select("well").distinct().join(kept, "well", "left").select("well", F.coalesce("kept", F.lit(False)).alias("kept"))


@query
def triplet_wells(spark, d):
    return cl.triplet_wells(tb.well_samples(spark, d))


# --- natural missingness ---------------------------------------------------------------------

@query
def cooccur_samples(spark, d):
    return rnd(ms.cooccur_samples(tb.well_samples(spark, d)).drop("pct"), prob=6)


@query
def cooccur_intervals(spark, d):
    iv = ms.intervals(ms.code_runs(tb.well_samples(spark, d)))
    return rnd(ms.cooccur_intervals(iv).drop("pct"), prob=6)


@query
def missing_intervals(spark, d):
    return ms.intervals(ms.code_runs(tb.well_samples(spark, d)))


@query
def interval_combos(spark, d):
    return ms.combinations(ms.intervals(ms.code_runs(tb.well_samples(spark, d))))


def _gaps(spark, d):
    s = tb.well_samples(spark, d)
    return ms.gaps(ms.code_runs(s), ms.well_lengths(s))


@query
def gap_lengths(spark, d):
    return rnd(_gaps(spark, d), length_m=6)


@query
def gap_quartiles(spark, d):
    return ms.gap_quartiles(_gaps(spark, d))


@query
def gaps_per_well(spark, d):
    return ms.gaps_per_well(_gaps(spark, d))


@query
def intact_segments(spark, d):
    return ms.intact_segments(ms.code_runs(tb.well_samples(spark, d)))


# --- windows, folds, scaling -------------------------------------------------------------------

@query
def windows_intact(spark, d):
    return wn.intact_windows(tb.well_samples(spark, d))


@query
def window_explode(spark, d):
    return rnd(wn.window_samples(tb.well_samples(spark, d)), gr=6, rhob=6, nphi=6)


@query
def folds_loo(spark, d):
    return wn.folds(wn.intact_windows(tb.well_samples(spark, d)))


@query
def loo_scaler(spark, d):
    return rnd(sc.fold_scaler(tb.well_samples(spark, d)), **{f"{k}_{c}": 6 for k in ("mu", "sd") for c in cl.COLS})


@query
def standardised_windows(spark, d):
    s = tb.well_samples(spark, d)
    z = sc.standardise(wn.window_samples(s), sc.fold_scaler(s))
    return rnd(z.select("well", "start", "t", *[f"z_{c}" for c in cl.COLS]), **{f"z_{c}": 6 for c in cl.COLS})


@query
def segment_tiles(spark, d):
    return wn.tile_segments(ms.intact_segments(ms.code_runs(tb.well_samples(spark, d))))


# --- masks -----------------------------------------------------------------------------------------

def _mask(scenario, **kw):
    def run(spark, d):
        ws = wn.window_samples(tb.well_samples(spark, d))
        return mk.mask_summary(mk.apply_masks(ws, [scenario], SEEDS, **kw))
    return run


for _s in SCENARIOS:
    QUERIES[f"mask_{_s}"] = _mask(_s)
QUERIES["mask_blackout_partial"] = _mask("blackout", allow_full=False)


@query
def mask_blackout_emp(spark, d):
    return em.plan_masks(tb.well_samples(spark, d))


@query
def training_mask(spark, d):
    s = tb.well_samples(spark, d)
    return mk.mask_summary(mk.training_masks(wn.window_samples(s), wn.intact_windows(s)))


@query
def window_split(spark, d):
    return mk.window_split(wn.intact_windows(tb.well_samples(spark, d))).drop("win_ord")


@query
def matched_subsample(spark, d):
    w = wn.intact_windows(tb.well_samples(spark, d))
    return mk.subsample(w, 25, seed=1).select("well", "start")


# --- imputers ----------------------------------------------------------------------------------------

def _impute(method, scenario, digits=5):
    def run(spark, d):
        p = predictions(tb.well_samples(spark, d), [method], [scenario])
        pts = im.to_points(p, [method], ["well", "start", "t"])
        return rnd(pts.select("well", "start", "t", "log", "pred"), pred=digits)
    return run


for _m, _s in (("mean", "profile"), ("locf", "block"), ("locf_win", "single"), ("interp_linear", "blackout"),
               ("interp_pchip", "block"), ("ridge", "blackout"), ("mice", "blackout")):
    # interpolated values are short decimals: nine digits keep rounding ties out of the comparison
    QUERIES[f"impute_{_m}"] = _impute(_m, _s, 9 if _m == "interp_linear" else 5)


@query
def impute_locf_well(spark, d):
    s = tb.well_samples(spark, d)
    return rnd(em.fill_well(s, "locf", sc.fold_scaler(s)), gr=6, rhob=6, nphi=6)


@query
def impute_interp_well(spark, d):
    s = tb.well_samples(spark, d)
    return rnd(em.fill_well(s, "interp_linear", sc.fold_scaler(s)), gr=6, rhob=6, nphi=6)


@query
def impute_pchip_well(spark, d):
    s = tb.well_samples(spark, d)
    return rnd(em.fill_well(s, "interp_pchip", sc.fold_scaler(s)), gr=6, rhob=6, nphi=6)


@query
def empirical_pchip(spark, d):
    return _empirical(spark, d, ("interp_pchip",), 5)


def _empirical(spark, d, methods, reps):
    st = em.empirical_stats(tb.well_samples(spark, d), methods, reps)
    return _by_log(st.select("method", "log", "well", "n", "sse", "sae"), "sse", "sae")


@query
def overlap_avg(spark, d):
    pts = em.evaluate_empirical(tb.well_samples(spark, d), ("locf_win",), 2)
    return rnd(pts.select("well", "seg_start", "rep", "idx", "log", "pred"), pred=5)


@query
def empirical_blackout(spark, d):
    return _empirical(spark, d, ("locf", "locf_win", "interp_linear"), 2)


# --- metrics ----------------------------------------------------------------------------------------------

@query
def entry_slice(spark, d):
    pts = evaluate(tb.well_samples(spark, d), ["locf"], ["block"])
    return rnd(mt.point_metrics(pts, ["method", "scenario"]), mae=6, rmse=6, r2=6, cc=6)


@query
def point_metrics(spark, d):
    return rnd(evaluate_metrics(tb.well_samples(spark, d), METHODS), mae=6, rmse=6, r2=6, cc=5)


@query
def pooled_vs_foldmean(spark, d):
    return rnd(evaluate_fold_mean(tb.well_samples(spark, d), METHODS), pooled_r2=5, fold_mean_r2=5)


@query
def suff_stats(spark, d):
    return _by_log(_suff(spark, d), "sum_y", "sum_y2", "sse", "sae")


@query
def macro_r2(spark, d):
    return rnd(mt.macro_r2(_suff(spark, d)), r2_macro=6)


@query
def nrmse_well(spark, d):
    s = tb.well_samples(spark, d)
    return rnd(mt.nrmse_per_well(_suff(spark, d), mt.scaler_sigma(sc.fold_scaler(s))), nrmse=6)


@query
def fallback_sigma(spark, d):
    return rnd(mt.fallback_sigma(_suff(spark, d)), sigma=5)


@query
def per_log_table(spark, d):
    return rnd(rp.per_log_table(_suff(spark, d)), r2_mean=6, r2_sd=6, mae_mean=6, rmse_mean=6)


@query
def main_table(spark, d):
    s = tb.well_samples(spark, d)
    t = rp.main_table(_suff(spark, d), mt.scaler_sigma(sc.fold_scaler(s)))
    return rnd(t, r2_macro_mean=6, r2_macro_sd=6, nrmse_well_q1=6, nrmse_well_median=6, nrmse_well_q3=6, nrmse_well_mean=6)


@query
def seed_variance(spark, d):
    t = rp.seed_variance(_suff(spark, d, methods=("mean", "locf"), init_seeds=(0, 1)))
    return rnd(t, r2_macro_mean=6, sd_init=6, sd_mask=6, sd_init_at_mask0=6)


@query
def rank_stability(spark, d):
    return rnd(rp.rank_stability(_suff(spark, d)), r2_all=6)


@query
def top_verdict(spark, d):
    return rp.top_verdict(rp.rank_stability(_suff(spark, d)))


@query
def seed_ci(spark, d):
    t = sg.mean_sd_ci(rp.all_log_r2(_suff(spark, d)), ["method", "scenario", "log"], "r2", "pooledR2_")
    return rnd(t, pooledR2_mean=6, pooledR2_std=6, pooledR2_ci_low=5, pooledR2_ci_high=5)


@query
def fold_spread(spark, d):
    return rnd(rp.fold_spread(_raw(spark, d, seeds=(0,))), fold_mean=9, fold_median=7)


@query
def dedup_raw(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").alias("seed"), F.col("event_type").alias("method"), "ts", "event_id", "value")
    return rp.keep_last(e, ["ts", "event_id"], ["seed", "method"]).select("seed", "method", "event_id", "value")


@query
def mask_parity(spark, d):
    s = _suff(spark, d, seeds=(0,))
    return s.groupBy("scenario", "mask_seed", "log").agg(F.countDistinct("method").alias("n_methods"), F.sum("n").alias("n_points")).join(
        rp.mask_parity(s).groupBy("scenario", "mask_seed", "log").agg(F.count(F.lit(1)).alias("bad")), ["scenario", "mask_seed", "log"], "left"
    ).select("scenario", "mask_seed", "log", "n_methods", "n_points", F.coalesce("bad", F.lit(0)).alias("bad"))


@query
def mask_ids(spark, d):
    s = tb.well_samples(spark, d)
    return rp.mask_ids(_suff(spark, d, methods=("mean",)), wn.folds(wn.intact_windows(s)))


# --- tests --------------------------------------------------------------------------------------------------

@query
def friedman_wells(spark, d):
    return rnd(sg.friedman_wells(_errors(spark, d)), chi2_F=5, kendall_W=6)


@query
def friedman_folds(spark, d):
    return rnd(sg.friedman_folds(_raw(spark, d).where("log = 'all'")), chi2_F=5, kendall_W=6)


@query
def nemenyi_ranks(spark, d):
    e = _errors(spark, d)
    sums = sg.rank_sums(sg.complete_blocks(e, ["scenario"], "well", "nrmse"), ["scenario"], "well", "nrmse")
    return rnd(sg.nemenyi(sums, ["scenario"]).drop("p"), rank_gap=6, q=5)


@query
def nemenyi_p(spark, d):
    e = _errors(spark, d)
    sums = sg.rank_sums(sg.complete_blocks(e, ["scenario"], "well", "nrmse"), ["scenario"], "well", "nrmse")
    return rnd(sg.nemenyi(sums, ["scenario"]), rank_gap=6, q=5, p=6)


@query
def wilcoxon_stat(spark, d):
    diff = sg.paired(_errors(spark, d), sg.pair_table(spark, PAIRS)).withColumn("d", F.round("d", 6))
    return rnd(sg.wilcoxon(cut_lineage(diff), p_values=False), median_diff=7, rank_biserial=6)


@query
def wilcoxon_allpairs_holm(spark, d):
    e = _errors(spark, d)
    diff = sg.paired(e, sg.all_pairs(e)).withColumn("d", F.round("d", 6))
    t = sg.holm(sg.wilcoxon(cut_lineage(diff)), ["scenario"], tie=["A", "B"])
    return t.select("scenario", "A", "B", F.round("median_diff", 7).alias("median_diff"), F.round("p", 8).alias("p"),
                    F.round("p_holm", 8).alias("p_holm"), "reject", F.round("rank_biserial", 6).alias("rank_biserial"))


@query
def holm(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", "l_linenumber").agg(
        F.avg("l_discount").alias("m"))
    p = li.select("l_returnflag", "l_linenumber", F.round(F.col("m") * F.col("m") * F.col("l_linenumber"), 8).alias("p"))
    return rnd(sg.holm(p, ["l_returnflag"], tie=["l_linenumber"]), p_holm=6)


@query
def spearman(spark, d):
    s = stored(tb.well_samples(spark, d))
    # one step at a time: each leaves a narrow table, and what it shuffled is deleted before the next
    gain = settled(sp.neighbour_gain(_errors(spark, d, s), "locf", "mean").withColumn("gain", F.round("gain", 6)))
    avail = settled(sp.neighbour_availability(*_availability_inputs(spark, d, s)).select("well", F.round("n_avail", 6).alias("n_avail")))
    both = settled(gain.join(avail, "well"))
    return rnd(sg.spearman(both, ["scenario"], "gain", "n_avail", p_values=False), rho=6)


@query
def bootstrap_delta(spark, d):
    return rnd(bs.delta_bootstrap(_suff(spark, d), sg.pair_table(spark, PAIRS)), delta=6, ci_lo=6, ci_hi=6, p_boot=6)


@query
def bootstrap_r2(spark, d):
    cells = spark.createDataFrame([(s, m, i) for m in METHODS for i, s in enumerate(SCENARIOS)], "scenario string, method string, pair_ord int")
    return rnd(bs.r2_bootstrap(_suff(spark, d, seeds=(0,)), cells), r2=6, ci_low=6, ci_high=6, boot_mean=6, boot_sd=6)


@query
def bootstrap_point(spark, d):
    return rnd(bs.delta_point(_suff(spark, d), sg.pair_table(spark, PAIRS)).select("scenario", "A", "B", "delta"), delta=6)


@query
def pair_alignment(spark, d):
    return alignment(tb.well_samples(spark, d), "mean", "locf").where("n > 0").select("scenario", "n", "bad")


# --- spatial ---------------------------------------------------------------------------------------------------

@query
def knn_graph(spark, d):
    return rnd(sp.knn_edges(tb.coords(spark, d)), d_km=6)


@query
def median_distance(spark, d):
    return rnd(sp.median_distance(tb.coords(spark, d)), scale_km=6)


@query
def adjacency(spark, d):
    c = tb.coords(spark, d)
    return rnd(sp.adjacency(sp.knn_edges(c), sp.median_distance(c)), d_km=6, weight=6)


@query
def graph_aggregate(spark, d):
    c = tb.coords(spark, d)
    s = tb.well_samples(spark, d)
    g = sp.on_grid(s, sp.grid_offsets(s)).select("well", "g", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in cl.COLS])
    return rnd(sp.message_pass(g, sp.adjacency(sp.knn_edges(c), sp.median_distance(c)), cl.COLS), gr=4, rhob=5, nphi=5)


@query
def grid_offsets(spark, d):
    return sp.grid_offsets(tb.well_samples(spark, d))


def _spatial(kind, scenarios=("block",)):
    def run(spark, d):
        s = stored(tb.well_samples(spark, d))
        off = sp.grid_offsets(s)
        c = tb.coords(spark, d)
        g = sp.on_grid(s, off)
        keys = ["well", "start", "t"] if len(scenarios) == 1 else ["scenario", "well", "start", "t"]
        if kind != "okrige":
            wm = cut_lineage(sc.window_moments(s))
            fits = sc.fold_fits(sc.leave_one_out(sc.well_moments(wm)))
            m = mk.mask_specs(wm.select("well", "start").join(fits, "well"), scenarios)
            pts = sp.spatial_points(m, g, c, off, kind, keys[:-1])
        else:
            m = mk.apply_masks(wn.window_samples(s), scenarios)
            ranges = sp.variogram_fits(sp.pair_semivariances(g, c), sp.median_distance(c))
            pts = im.to_points(sp.predict_spatial(m, sc.fold_scaler(s), g, c, off, kind, ranges), [kind], keys)
        return rnd(pts.select(*keys, "log", "pred"), pred=4)
    return run


for _k in ("idw", "nnwell", "okrige"):
    QUERIES[f"impute_{_k}"] = _spatial(_k, SCENARIOS if _k == "okrige" else ("block",))


@query
def variogram_pairs(spark, d):
    s = stored(tb.well_samples(spark, d))
    g = sp.on_grid(s, sp.grid_offsets(s))
    p = sp.pair_semivariances(g, tb.coords(spark, d))
    # compared as the sum of squared differences: short decimals, so rounding never ties
    return rnd(p.withColumn("sum_sq", F.col("gamma") * 2 * F.col("n")).drop("gamma"), d_km=6, sum_sq=6)


def _availability_inputs(spark, d, samples=None):
    s = tb.well_samples(spark, d) if samples is None else samples
    c = tb.coords(spark, d)
    e = sp.knn_edges(c)
    off = sp.grid_offsets(s)
    return (wn.intact_windows(s), e, sp.adjacency(e, sp.median_distance(c)), sp.on_grid(s, off), off)


@query
def neighbour_availability(spark, d):
    return rnd(sp.neighbour_availability(*_availability_inputs(spark, d)), n_avail=6, d_nearest_km=6, w_avail=6)


@query
def norm_ids(spark, d):
    sup = spark.read.parquet(f"{d}/supplier.parquet")
    raw = F.concat(F.lower("s_name"), F.lit("_ss--"), F.col("s_nationkey").cast("string"), F.lit("d-14-"), F.col("s_suppkey").cast("string"), F.lit("x"))
    return sup.select("s_suppkey", sp.normalise_id(raw).alias("norm_id"))


# --- leakage and figures --------------------------------------------------------------------------------------------

@query
def leak_overlap_antijoin(spark, d):
    w = wn.intact_windows(tb.well_samples(spark, d))
    test, sets = lk.train_sets(w)
    return sets["B_window_no_overlap"]


@query
def leak_matched_sizes(spark, d):
    w = wn.intact_windows(tb.well_samples(spark, d))
    return lk.matched_counts(w, *lk.train_sets(w))


@query
def leak_matched(spark, d):
    s = stored(tb.well_samples(spark, d))
    return rnd(lk.matched_experiment(s, coords=tb.coords(spark, d)), r2=6)


@query
def leak_window_split(spark, d):
    s = tb.well_samples(spark, d)
    return rnd(lk.leak_split_metrics(s), mae=5, rmse=5, r2=5, cc=4)


@query
def histogram(spark, d):
    return rp.histogram(tb.well_samples(spark, d))


@query
def pairwise_corr(spark, d):
    return rnd(rp.pairwise_corr(tb.well_samples(spark, d)), r=6)


@query
def hexbin(spark, d):
    return rp.hexbin(tb.well_samples(spark, d), "GR", "RHOB")


# --- whole sizes of queries whose SQL twin states a smaller one ---------------------------------------------------------

WHOLE_SEEDS, WHOLE_REPS = (0, 1, 2, 3, 4), 5


@query
def whole_suff_stats(spark, d):
    return _by_log(_suff(spark, d, WHOLE_SEEDS, im.NATIVE), "sum_y", "sum_y2", "sse", "sae")


@query
def whole_main_table(spark, d):
    s = tb.well_samples(spark, d)
    t = rp.main_table(_suff(spark, d, WHOLE_SEEDS, im.NATIVE), mt.scaler_sigma(sc.fold_scaler(s)))
    return rnd(t, r2_macro_mean=6, r2_macro_sd=6, nrmse_well_q1=6, nrmse_well_median=6, nrmse_well_q3=6, nrmse_well_mean=6)


@query
def whole_fold_spread(spark, d):
    raw = _raw(spark, d, WHOLE_SEEDS, im.NATIVE)
    return rnd(rp.fold_spread(raw), fold_mean=9, fold_median=7)


@query
def whole_empirical_blackout(spark, d):
    return _empirical(spark, d, im.NATIVE, WHOLE_REPS)


@query
def whole_hexbin(spark, d):
    s, out = tb.well_samples(spark, d), None
    for a, b in (("GR", "RHOB"), ("GR", "NPHI"), ("RHOB", "NPHI")):
        part = rp.hexbin(s, a, b).select(F.lit(a).alias("log_x"), F.lit(b).alias("log_y"), "*")
        out = part if out is None else out.unionByName(part)
    return out


for _k in ("idw", "nnwell"):
    QUERIES[f"whole_{_k}"] = _spatial(_k, SCENARIOS)
