"""Result tables from sufficient statistics: per-log, main, ranks, variance, stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LOGS, ORDER
from ..functions.ranks import exact_percentiles
from ..operators.masking import _with_scalar
from ..operators.metrics import CELL, macro_r2, merge_stats, nrmse_per_well, pooled_from_stats, r2_from_stats
from ..operators.significance import mean_sd_ci, seed_average


#: scores equal to this many digits tie; the order of a distributed sum is not fixed
TIE_DIGITS = 9


def method_order(df: DataFrame, col: str = "method") -> DataFrame:
    """Add ``method_ord``: canonical methods first, the others by name after them."""
    place = F.coalesce(*[F.when(F.col(col) == m, F.lit(i)) for i, m in enumerate(ORDER)], F.lit(len(ORDER)))
    return df.withColumn("method_ord", place)


def per_log_table(suff: DataFrame) -> DataFrame:
    """method, scenario, log: mean and sd over seeds of the pooled R2, mean MAE and RMSE."""
    per = pooled_from_stats(suff, [*CELL, "log"])
    return per.groupBy("method", "scenario", "log").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("r2").alias("r2_mean"),
        F.coalesce(F.stddev_samp("r2"), F.lit(0.0)).alias("r2_sd"),
        F.avg("mae").alias("mae_mean"), F.avg("rmse").alias("rmse_mean"))


def main_table(suff: DataFrame, sigma: DataFrame) -> DataFrame:
    """The headline table: macro R2 over seeds, its rank, and the spread of the per-well error.

    Ties in the rank break by canonical method order.
    """
    macro = macro_r2(suff).groupBy("method", "scenario").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("r2_macro").alias("r2_macro_mean"),
        F.coalesce(F.stddev_samp("r2_macro"), F.lit(0.0)).alias("r2_macro_sd"))
    w = Window.partitionBy("scenario").orderBy(F.round("r2_macro_mean", TIE_DIGITS).desc(), "method_ord", "method")
    ranked = method_order(macro).withColumn("rank_r2_macro", F.row_number().over(w)).drop("method_ord")
    err = seed_average(nrmse_per_well(suff, sigma))
    spread = exact_percentiles(err, ["method", "scenario"], "nrmse",
                               {"nrmse_well_q1": 0.25, "nrmse_well_median": 0.5, "nrmse_well_q3": 0.75}).drop("n")
    mean = err.groupBy("method", "scenario").agg(F.avg("nrmse").alias("nrmse_well_mean"))
    return ranked.join(spread, ["method", "scenario"], "left").join(mean, ["method", "scenario"], "left")


def all_log_r2(suff: DataFrame, keys: Sequence[str] = tuple(CELL)) -> DataFrame:
    """Pooled R2 over all logs together (``log = 'all'``) and per log."""
    per = pooled_from_stats(suff, [*keys, "log"]).select(*keys, "log", "r2")
    both = merge_stats(suff, keys).select(*keys, F.lit("all").alias("log"), r2_from_stats().alias("r2"))
    return per.unionByName(both)


def rank_stability(suff: DataFrame) -> DataFrame:
    """Rank of every method per (scenario, seed) by the pooled R2 over all logs."""
    v = all_log_r2(suff).where("log = 'all' AND r2 IS NOT NULL")
    w = Window.partitionBy("scenario", "mask_seed").orderBy(F.round("r2", TIE_DIGITS).desc(), "method_ord", "method")
    return method_order(v).select("scenario", F.col("mask_seed").alias("seed"), F.row_number().over(w).alias("rank"), "method",
                                  F.col("r2").alias("r2_all"))


def top_verdict(ranks: DataFrame) -> DataFrame:
    """Whether one method leads a scenario under every seed."""
    return ranks.where("rank = 1").groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.countDistinct("method").alias("n_leaders"),
        F.array_join(F.array_sort(F.collect_set("method")), ",").alias("leaders")).withColumn(
        "verdict", F.when(F.col("n_leaders") == 1, "STABLE").otherwise("UNSTABLE"))


def seed_variance(suff: DataFrame) -> DataFrame:
    """Initialisation and mask variability of the macro R2 over the seed x mask matrix."""
    cell = macro_r2(suff)
    first = cell.groupBy("method", "scenario").agg(F.min("mask_seed").alias("_m0"))
    row = cell.groupBy("method", "scenario", "init_seed").agg(F.avg("r2_macro").alias("v"))
    col = cell.groupBy("method", "scenario", "mask_seed").agg(F.avg("r2_macro").alias("v"))
    key = ["method", "scenario"]
    base = cell.groupBy(*key).agg(F.countDistinct("init_seed").alias("n_init_seeds"), F.countDistinct("mask_seed").alias("n_mask_seeds"),
                                  F.avg("r2_macro").alias("r2_macro_mean"), F.count("r2_macro").alias("n_cells"))
    sd_i = row.groupBy(*key).agg(F.stddev_samp("v").alias("sd_init"))
    sd_m = col.groupBy(*key).agg(F.stddev_samp("v").alias("sd_mask"))
    sd_0 = cell.join(first, key).where("mask_seed = _m0").groupBy(*key).agg(F.stddev_samp("r2_macro").alias("sd_init_at_mask0"))
    return base.join(sd_i, key).join(sd_m, key).join(sd_0, key)


def raw_metrics(fold_metrics: DataFrame, folds: DataFrame) -> DataFrame:
    """Per-cell rows (seed, method, scenario, fold, log, r2, mae)."""
    f = folds.select(F.col("test_well").alias("well"), F.col("fold_id").alias("fold"))
    return fold_metrics.join(f, "well").select(
        F.col("mask_seed").alias("seed"), "method", "scenario", "fold", "log", "r2", "mae")


def keep_last(raw: DataFrame, order: Sequence[str], keys: Sequence[str] = ("seed", "method", "scenario", "fold", "log")) -> DataFrame:
    """One row per cell, the one written last; replays of a fold replace earlier rows."""
    rest = [c for c in raw.columns if c not in keys]
    best = raw.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def aggregated_table(suff: DataFrame, raw: DataFrame) -> DataFrame:
    """Pooled R2 over seeds with a Student-t interval, beside the per-fold median averaged over seeds."""
    pooled = mean_sd_ci(all_log_r2(suff), ["method", "scenario", "log"], "r2", "pooledR2_")
    med = exact_percentiles(raw, ["seed", "method", "scenario", "log"], "r2", {"m": 0.5})
    fold = med.groupBy("method", "scenario", "log").agg(
        F.avg("m").alias("perfoldMedianR2_mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("perfoldMedianR2_std"))
    return pooled.join(fold, ["method", "scenario", "log"], "left")


def mask_parity(suff: DataFrame) -> DataFrame:
    """Cells where methods or init seeds disagree on the number of masked points (should be none)."""
    return suff.groupBy("scenario", "mask_seed", "log", "well").agg(
        F.countDistinct("n").alias("n_distinct"), F.countDistinct("method").alias("n_methods")).where("n_distinct > 1")


def mask_ids(suff: DataFrame, folds: DataFrame) -> DataFrame:
    """Masked points per log of every (scenario, mask seed, fold) with the fold's label."""
    one = suff.groupBy("scenario", "mask_seed", "well", "log").agg(F.max("n").alias("n"))
    wide = one.groupBy("scenario", "mask_seed", "well").pivot("log", list(LOGS)).agg(F.first("n"))
    f = folds.select(F.col("test_well").alias("well"), F.col("fold_id").alias("fold"))
    return wide.join(f, "well").select("scenario", "mask_seed", "fold", fold_label("fold").alias("label"),
                                       *[F.coalesce(lg, F.lit(0)).alias(f"n_{lg}") for lg in LOGS])


def fold_label(fold: str = "fold"):
    """Zero-padded public label of a fold: W01, W02, ..."""
    return F.format_string("W%02d", (F.col(fold) + 1).cast("int"))


# --- figure-backing series ---------------------------------------------------------------------

def histogram(samples: DataFrame, bins: int = 80) -> DataFrame:
    """Equal-width histogram of every channel between its own minimum and maximum."""
    box = samples.agg(*[f(lg.lower()).alias(f"{n}_{lg}") for lg in LOGS for n, f in (("lo", F.min), ("hi", F.max))])
    long = _with_scalar(samples, box).select(F.inline(F.array(*[
        F.struct(F.lit(lg).alias("log"), F.col(lg.lower()).alias("v"), F.col(f"lo_{lg}").alias("lo"), F.col(f"hi_{lg}").alias("hi")) for lg in LOGS])))
    pos = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return (long.where("v IS NOT NULL").withColumn("bin", F.least(F.coalesce(pos, F.lit(0)), F.lit(bins - 1)).cast("int"))
            .groupBy("log", "bin").agg(F.count(F.lit(1)).alias("n")))


def pairwise_corr(samples: DataFrame) -> DataFrame:
    """Pearson correlation of every channel pair over samples with both measured."""
    pairs = [(a, b) for i, a in enumerate(LOGS) for b in LOGS[i + 1:]]
    both = lambda a, b: F.col(a.lower()).isNotNull() & F.col(b.lower()).isNotNull()
    agg = samples.agg(*[v for a, b in pairs for v in (
        F.corr(a.lower(), b.lower()).alias(f"r_{a}_{b}"), F.sum(both(a, b).cast("bigint")).alias(f"n_{a}_{b}"))])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(a).alias("log_a"), F.lit(b).alias("log_b"),
                                                  F.col(f"r_{a}_{b}").alias("r"), F.col(f"n_{a}_{b}").alias("n")) for a, b in pairs])))


def hexbin(samples: DataFrame, a: str, b: str, gridsize: int = 60) -> DataFrame:
    """Hexagonal bin counts of two channels: two offset lattices, each point in the nearer cell."""
    x, y = a.lower(), b.lower()
    df = samples.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    box = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    nx, ny = gridsize, int(gridsize / 3 ** 0.5)
    d = _with_scalar(df, box).select(((F.col("x") - F.col("x0")) / ((F.col("x1") - F.col("x0")) / nx)).alias("u"),
                                  ((F.col("y") - F.col("y0")) / ((F.col("y1") - F.col("y0")) / ny)).alias("v"))
    d = d.select("u", "v", F.bround("u").alias("i1"), F.bround("v").alias("j1"), F.floor("u").alias("i2"), F.floor("v").alias("j2"))
    d1 = F.pow(F.col("u") - F.col("i1"), 2) + 3 * F.pow(F.col("v") - F.col("j1"), 2)
    d2 = F.pow(F.col("u") - F.col("i2") - 0.5, 2) + 3 * F.pow(F.col("v") - F.col("j2") - 0.5, 2)
    first = d1 < d2
    return (d.select(F.when(first, 0).otherwise(1).alias("lattice"),
                     F.when(first, F.col("i1")).otherwise(F.col("i2")).cast("int").alias("i"),
                     F.when(first, F.col("j1")).otherwise(F.col("j2")).cast("int").alias("j"))
            .groupBy("lattice", "i", "j").agg(F.count(F.lit(1)).alias("n")))


def fold_spread(raw: DataFrame) -> DataFrame:
    """Per-fold mean and median of R2, the aggregation contrasted with the pooled value."""
    med = exact_percentiles(raw, ["method", "scenario", "log"], "r2", {"fold_median": 0.5}).drop("n")
    mean = raw.groupBy("method", "scenario", "log").agg(F.avg("r2").alias("fold_mean"), F.count("r2").alias("n_folds"))
    return mean.join(med, ["method", "scenario", "log"], "left")
