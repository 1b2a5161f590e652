"""Point metrics, pooled aggregation and mergeable per-well sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CELL = ["method", "init_seed", "mask_seed", "scenario"]
FIELDS = ["n", "sum_y", "sum_y2", "sse", "sae"]


def _err() -> Column:
    return F.col("pred") - F.col("truth")


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; NULL instead of a division error when a side has no spread."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def metric_columns() -> list[Column]:
    """mae, rmse, r2, cc, n of a group of (pred, truth) rows.

    R2 compares with the mean of the group itself and is NULL when the truth is constant;
    the correlation is NULL below two points or without spread.
    """
    sst = F.var_pop("truth") * F.count("truth")
    spread = (F.stddev_pop("pred") > 1e-12) & (F.stddev_pop("truth") > 0) & (F.count("truth") > 1)
    return [
        F.avg(F.abs(_err())).alias("mae"),
        F.sqrt(F.avg(_err() * _err())).alias("rmse"),
        F.when(sst > 0, 1 - F.sum(_err() * _err()) / sst).alias("r2"),
        F.when(spread, safe_corr("pred", "truth")).alias("cc"),
        F.count("truth").alias("n"),
    ]


def point_metrics(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics per log and over all logs together (``log = 'all'``)."""
    keys = list(keys)
    sets = [[F.col(k) for k in [*keys, "log"]], [F.col(k) for k in keys]]
    out = points.groupingSets(sets, *[F.col(k) for k in [*keys, "log"]]).agg(*metric_columns())
    return out.withColumn("log", F.coalesce("log", F.lit("all")))


def metrics_of_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of :func:`metric_columns` from the rows of :func:`gapwright.operators.imputers.run_moments`.

    Means are added up as offsets from the least of their group: nothing cancels, and a constant keeps a spread of exactly 0.
    ``parts`` is read twice.
    """
    keys = list(keys)
    base = parts.groupBy(*keys).agg(F.min("my").alias("_y"), F.min("mp").alias("_p"))
    y, p, n = F.col("my") - F.col("_y"), F.col("mp") - F.col("_p"), F.col("n")
    s = parts.join(base, keys).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "vy", "vp", "vyp", "sse", "sae")], F.sum(n * y).alias("_sy"), F.sum(n * p).alias("_sp"),
        F.sum(n * y * y).alias("_syy"), F.sum(n * p * p).alias("_spp"), F.sum(n * y * p).alias("_syp"))
    spread = lambda v, ab, a, b: F.col(v) + F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    s = s.select(*keys, "n", "sse", "sae", F.greatest(spread("vy", "_syy", "_sy", "_sy"), F.lit(0.0)).alias("_yy"),
                 F.greatest(spread("vp", "_spp", "_sp", "_sp"), F.lit(0.0)).alias("_pp"), spread("vyp", "_syp", "_sy", "_sp").alias("_yp"))
    wide = (F.sqrt(F.col("_pp") / F.col("n")) > 1e-12) & (F.col("_yy") > 0) & (F.col("n") > 1)
    return s.select(*keys, (F.col("sae") / F.col("n")).alias("mae"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
                    F.when(F.col("_yy") > 0, 1 - F.col("sse") / F.col("_yy")).alias("r2"),
                    F.when(wide, F.try_divide(F.col("_yp"), F.sqrt("_yy") * F.sqrt("_pp"))).alias("cc"), "n")


def point_metrics_of_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`point_metrics` from the rows of :func:`gapwright.operators.imputers.run_moments`."""
    logs = F.explode(F.array(F.col("log"), F.lit("all"))).alias("log")
    both = cut_lineage(parts).select(*[c for c in parts.columns if c != "log"], logs)
    return metrics_of_moments(both, [*keys, "log"]).select(*keys, "log", "mae", "rmse", "r2", "cc", "n")


def sufficient_stats(points: DataFrame, keys: Sequence[str] = (*CELL, "log", "well")) -> DataFrame:
    """(n, sum y, sum y^2, SSE, SAE) per cell and well.

    Additive, so every pooled metric on any subset or resample of wells follows from these
    rows; the points themselves are combined map-side and never shuffled.
    """
    return points.groupBy(*keys).agg(
        F.count("truth").alias("n"), F.sum("truth").alias("sum_y"),
        F.sum(F.col("truth") * F.col("truth")).alias("sum_y2"),
        F.sum(_err() * _err()).alias("sse"), F.sum(F.abs(_err())).alias("sae"))


def stats_from_predictions(pred: DataFrame, methods: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Sufficient statistics straight from wide predictions.

    Same rows as :func:`sufficient_stats`, without unpivoting a single point: one
    conditional aggregate per (method, log), unpivoted after the reduction.
    """
    logs = ("gr", "rhob", "nphi")
    aggs = []
    for i, c in enumerate(logs):
        hit = F.col("mask_bits").bitwiseAND(1 << i) > 0
        y = F.when(hit, F.col(c))
        aggs += [F.count(y).alias(f"n_{c}"), F.sum(y).alias(f"y_{c}"), F.sum(y * y).alias(f"yy_{c}")]
        for m in methods:
            e = F.when(hit, F.col(f"p_{m}_{c}") - F.col(c))
            aggs += [F.sum(e * e).alias(f"sse_{m}_{c}"), F.sum(F.abs(e)).alias(f"sae_{m}_{c}")]
    return _unpivoted(pred.groupBy(*keys).agg(*aggs), methods, keys)


def stats_from_sums(parts: DataFrame, methods: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The same statistics from additive parts: counts and sums under the names of the aggregates above."""
    sums = [c for c in parts.columns if c.split("_")[0] in ("n", "y", "yy", "sse", "sae")]
    return _unpivoted(parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]), methods, keys)


def _unpivoted(wide: DataFrame, methods: Sequence[str], keys: Sequence[str]) -> DataFrame:
    logs = ("gr", "rhob", "nphi")
    rows = [F.struct(F.lit(m).alias("method"), F.lit(c.upper()).alias("log"), F.col(f"n_{c}").alias("n"),
                     F.col(f"y_{c}").alias("sum_y"), F.col(f"yy_{c}").alias("sum_y2"),
                     F.col(f"sse_{m}_{c}").alias("sse"), F.col(f"sae_{m}_{c}").alias("sae"))
            for m in methods for c in logs]
    return wide.select(*keys, F.inline(F.array(*rows))).where("n > 0")


def merge_stats(suff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up sufficient statistics to a coarser key (drop wells, replicates, logs)."""
    return suff.groupBy(*keys).agg(*[F.sum(f).alias(f) for f in FIELDS])


def weighted_stats(suff: DataFrame, mult: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sufficient statistics of a resample: ``mult`` holds (well, weight) or more keys."""
    j = suff.join(mult, "well")
    return j.groupBy(*keys).agg(*[F.sum(F.col(f) * F.col("weight")).alias(f) for f in FIELDS])


def r2_from_stats() -> Column:
    """Pooled R2 from additive statistics; NULL for n <= 1 or a constant truth."""
    sst = F.col("sum_y2") - F.col("sum_y") * F.col("sum_y") / F.col("n")
    return F.when((F.col("n") > 1) & (sst > 0), 1 - F.col("sse") / sst)


def pooled_from_stats(suff: DataFrame, keys: Sequence[str] = (*CELL, "log")) -> DataFrame:
    """r2, mae, rmse of each cell from additive statistics."""
    return merge_stats(suff, keys).select(
        *keys, "n", r2_from_stats().alias("r2"),
        F.when(F.col("n") > 0, F.col("sae") / F.col("n")).alias("mae"),
        F.when(F.col("n") > 0, F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"))


def macro_r2(suff: DataFrame, keys: Sequence[str] = tuple(CELL), n_logs: int = 3) -> DataFrame:
    """Equal-weight mean of the per-log R2; NULL unless every log has one."""
    per = pooled_from_stats(suff, [*keys, "log"])
    return per.groupBy(*keys).agg(
        F.when((F.count("r2") == n_logs) & (F.count(F.lit(1)) == n_logs), F.avg("r2")).alias("r2_macro"))


def fallback_sigma(suff: DataFrame, keys: Sequence[str] = tuple(CELL)) -> DataFrame:
    """Spread of the truth over all other wells, from additive statistics."""
    group = [*keys, "log"]
    total = suff.groupBy(*group).agg(*[F.sum(f).alias(f"t_{f}") for f in ("n", "sum_y", "sum_y2")])
    n, sy, sy2 = (F.col(f"t_{f}") - F.col(f) for f in ("n", "sum_y", "sum_y2"))
    var = F.greatest(F.try_divide(sy2, n) - F.pow(F.try_divide(sy, n), 2), F.lit(0.0))
    return suff.join(total, group).select(*group, "well", F.when(n > 1, F.sqrt(var)).alias("sigma"))


def scaler_sigma(scale: DataFrame) -> DataFrame:
    """Training sigma per (well, log) from a fold scaler."""
    return scale.select("well", F.inline(F.array(*[
        F.struct(F.lit(c).alias("log"), F.col(f"sd_{c.lower()}").alias("sigma")) for c in ("GR", "RHOB", "NPHI")])))


def nrmse_per_well(suff: DataFrame, sigma: DataFrame, keys: Sequence[str] = tuple(CELL)) -> DataFrame:
    """sqrt of the mean over logs of SSE / (n sigma^2); logs without points are skipped."""
    on = [k for k in [*keys, "log", "well"] if k in sigma.columns]
    ratio = F.when(F.col("n") > 0, F.try_divide(F.col("sse"), F.col("n") * F.col("sigma") * F.col("sigma")))
    return suff.join(sigma, on).groupBy(*keys, "well").agg(F.sqrt(F.avg(ratio)).alias("nrmse"))


def fold_mean_r2_of_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`fold_mean_r2` from moments kept by well."""
    parts = cut_lineage(parts)
    fold = metrics_of_moments(parts, [*keys, "well"]).where("r2 IS NOT NULL")
    per = fold.groupBy(*keys).agg(F.avg("r2").alias("fold_mean_r2"), F.count("r2").alias("n_folds"))
    pooled = metrics_of_moments(parts, keys).select(*keys, F.col("r2").alias("pooled_r2"), "n")
    return pooled.join(per, list(keys))


def fold_mean_r2(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled R2 beside the mean and median of the per-fold R2 (the flawed average)."""
    fold = points.groupBy(*keys, "well").agg(*metric_columns()).where("r2 IS NOT NULL")
    per = fold.groupBy(*keys).agg(F.avg("r2").alias("fold_mean_r2"), F.count("r2").alias("n_folds"))
    pooled = points.groupBy(*keys).agg(*metric_columns()).select(*keys, F.col("r2").alias("pooled_r2"), "n")
    return pooled.join(per, list(keys))
