"""Rank tests on per-well (or per-fold) values.

Ranks, rank sums and tie counts are DataFrame work; only the final tail probability of an
already aggregated row goes through a vectorised Python function.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import ALPHA
from ..functions.distributions import chi2_sf, column, range_sf, t_ppf, t_sf2, wilcoxon_p
from .metrics import safe_corr
from ..functions.ranks import average_rank, exact_percentiles, rank_table


def seed_average(nrmse: DataFrame, keys: Sequence[str] = ("method", "scenario", "well")) -> DataFrame:
    """Average the per-well error over seeds before any test."""
    return nrmse.groupBy(*keys).agg(F.avg("nrmse").alias("nrmse"))


def block_ranks(values: DataFrame, keys: Sequence[str], block: str, value: str,
                ascending: bool = True) -> DataFrame:
    """Tie-averaged rank of each method inside its block; one block holds one row per method."""
    order = F.col(value) if ascending else F.col(value).desc()
    w = Window.partitionBy(*keys, block).orderBy(order)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, block, value))
    return values.withColumn("tie", ties).withColumn("rank", F.rank().over(w) + (F.col("tie") - 1) / F.lit(2.0))


def complete_blocks(values: DataFrame, keys: Sequence[str], block: str, value: str) -> DataFrame:
    """Blocks in which every method of the cell has a value."""
    k = values.groupBy(*keys).agg(F.countDistinct("method").alias("k"))
    full = (values.groupBy(*keys, block).agg(F.count(value).alias("_have")).join(k, list(keys))
            .where(F.col("_have") == F.col("k")).select(*keys, block, "k"))
    return values.join(full, [*keys, block])


def complete_methods(values: DataFrame, keys: Sequence[str], block: str, value: str) -> DataFrame:
    """Methods with a value in every block of the cell; ``k`` is how many there are."""
    blocks = values.groupBy(*keys).agg(F.countDistinct(block).alias("_n"))
    full = (values.groupBy(*keys, "method").agg(F.count(value).alias("_have")).join(blocks, list(keys))
            .where((F.col("_have") == F.col("_n")) & (F.col("_n") >= 3)).select(*keys, "method"))
    k = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    return values.join(full, [*keys, "method"]).join(k, list(keys))


def rank_sums(values: DataFrame, keys: Sequence[str], block: str, value: str, ascending: bool = True) -> DataFrame:
    """Rank sum, mean rank and tie term per (cell, method) of complete data carrying ``k``."""
    r = block_ranks(values, keys, block, value, ascending)
    return r.groupBy(*keys, "method").agg(
        F.sum("rank").alias("rank_sum"), F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("tie") * F.col("tie") - 1).alias("tie_term"), F.first("k").alias("k"))


def friedman(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Friedman chi-square (tie corrected) and Kendall's W per cell; NULL below 3 x 3."""
    agg = sums.groupBy(*keys).agg(
        F.max("k").alias("k"), F.max("n").alias("n_blocks"),
        F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("_ss"), F.sum("tie_term").alias("_ties"))
    k, n = F.col("k").cast("double"), F.col("n_blocks").cast("double")
    raw = 12.0 / (k * n * (k + 1)) * F.col("_ss") - 3.0 * n * (k + 1)
    chi2 = F.when((k >= 3) & (n >= 3), F.try_divide(raw, 1.0 - F.try_divide(F.col("_ties"), k * (k * k - 1) * n)))
    return agg.select(*keys, F.col("k").alias("k_methods"), "n_blocks", chi2.alias("chi2_F"),
                      F.try_divide(chi2, n * (k - 1)).alias("kendall_W"))


def with_p(stats: DataFrame) -> DataFrame:
    """Add the chi-square tail probability ``p``."""
    return stats.withColumn("p", column(chi2_sf, F.col("chi2_F"), (F.col("k_methods") - 1).cast("double")))


def friedman_wells(errors: DataFrame, keys: Sequence[str] = ("scenario",), methods: Iterable[str] | None = None) -> DataFrame:
    """Friedman across wells on the per-well error; incomplete wells are dropped."""
    if methods is not None:
        errors = errors.where(F.col("method").isin(*methods))
    return friedman(rank_sums(complete_blocks(errors, keys, "well", "nrmse"), keys, "well", "nrmse"), keys)


def friedman_folds(raw: DataFrame, keys: Sequence[str] = ("scenario", "seed")) -> DataFrame:
    """Friedman with folds as blocks on the per-fold R2; incomplete methods are dropped."""
    v = complete_methods(raw, keys, "fold", "r2")
    return friedman(rank_sums(v, keys, "fold", "r2", ascending=False), keys)


def nemenyi(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Post-hoc p-value of every pair of methods from their mean ranks."""
    a = sums.select(*keys, F.col("method").alias("A"), F.col("mean_rank").alias("ra"), "k", "n")
    b = sums.select(*keys, F.col("method").alias("B"), F.col("mean_rank").alias("rb"))
    pair = a.join(b, list(keys)).where("A < B")
    k = F.col("k").cast("double")
    q = F.abs(F.col("ra") - F.col("rb")) / F.sqrt(k * (k + 1) / (6.0 * F.col("n"))) * F.sqrt(F.lit(2.0))
    return pair.select(*keys, "A", "B", F.abs(F.col("ra") - F.col("rb")).alias("rank_gap"), q.alias("q"),
                       column(range_sf, q, F.col("k").cast("int")).alias("p"))


def pair_table(spark: SparkSession, families: dict[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """Declared comparisons as rows (scenario, pair_ord, A, B)."""
    rows, i = [], 0
    for sc, pairs in families.items():
        for a, b in pairs:
            rows.append((sc, i, a, b))
            i += 1
    return spark.createDataFrame(rows, "scenario string, pair_ord int, A string, B string")


def all_pairs(values: DataFrame) -> DataFrame:
    """Every unordered pair of methods of a scenario (method count squared, never rows squared)."""
    m = values.select("scenario", "method").distinct()
    return (m.select("scenario", F.col("method").alias("A")).join(m.select("scenario", F.col("method").alias("B")), "scenario")
            .where("A < B").withColumn("pair_ord", F.row_number().over(Window.partitionBy("scenario").orderBy("A", "B")) - 1))


def paired(values: DataFrame, pairs: DataFrame, value: str = "nrmse", block: str = "well",
           keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """One row per (pair, block) with both values and their difference ``d``."""
    base = [*keys, block]
    a = values.select(*base, F.col("method").alias("A"), F.col(value).alias("va"))
    b = values.select(*base, F.col("method").alias("B"), F.col(value).alias("vb"))
    return (a.join(pairs, [k for k in keys if k in pairs.columns] + ["A"]).join(b, [*base, "B"])
            .where("va IS NOT NULL AND vb IS NOT NULL").withColumn("d", F.col("va") - F.col("vb")))


def wilcoxon(diff: DataFrame, keys: Sequence[str] = ("scenario", "pair_ord", "A", "B"), p_values: bool = True) -> DataFrame:
    """Signed-rank statistic, rank-biserial effect and median difference per pair.

    Zero differences are dropped from the ranking.  Below five pairs, or when every
    difference is zero, statistic, effect and p are NULL.
    """
    keys = list(keys)
    base = diff.groupBy(*keys).agg(F.count("d").alias("n"), F.sum((F.col("d") == 0).cast("int")).alias("n_zero"))
    med = exact_percentiles(diff, keys, "d", {"median_diff": 0.5}).drop("n")
    ranks = rank_table(diff.where("d <> 0").withColumn("_abs", F.abs("d")), keys, "_abs",
                       {"pos": F.sum((F.col("d") > 0).cast("int"))})
    sums = ranks.groupBy(*keys).agg(
        F.sum(F.col("avg_rank") * F.col("pos")).alias("t_plus"),
        F.sum(F.col("avg_rank") * (F.col("cnt") - F.col("pos"))).alias("t_minus"),
        F.sum(F.col("cnt") * F.col("cnt") * F.col("cnt") - F.col("cnt")).cast("double").alias("tie_term"))
    j = base.join(med, keys, "left").join(sums, keys, "left")
    ok = (F.col("n") >= 5) & F.col("t_plus").isNotNull()
    out = j.select(
        *keys, "n", "n_zero", "median_diff", "t_plus", "t_minus", "tie_term",
        F.when(ok, F.least("t_plus", "t_minus")).alias("W_stat"),
        F.when(ok, (F.col("t_plus") - F.col("t_minus")) / (F.col("t_plus") + F.col("t_minus"))).alias("rank_biserial"))
    if not p_values:
        return out.drop("tie_term")
    return out.withColumn("p", column(wilcoxon_p, "W_stat", (F.col("n") - F.col("n_zero")).cast("int"),
                                      F.col("n_zero").cast("int"), F.col("tie_term"))).drop("tie_term")


def holm(tests: DataFrame, family: Sequence[str], p: str = "p", tie: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Holm step-down inside each family: ``p_holm`` and ``reject``; NULL p is left untouched."""
    fam = Window.partitionBy(*family, F.col(p).isNull())
    seq = fam.orderBy(p, *tie)
    run = seq.rowsBetween(Window.unboundedPreceding, 0)
    left = F.count(F.lit(1)).over(fam) - F.row_number().over(seq) + 1
    df = tests.withColumn("_left", left)
    adj = F.max(F.least(F.lit(1.0), F.col("_left") * F.col(p))).over(run)
    pas = F.min((F.col(p) <= F.lit(alpha) / F.col("_left")).cast("int")).over(run)
    live = F.col(p).isNotNull()
    return df.withColumn("p_holm", F.when(live, adj)).withColumn(
        "reject", F.when(live, pas == 1).otherwise(F.lit(False))).drop("_left")


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, p_values: bool = True) -> DataFrame:
    """Spearman correlation of two columns per group."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = average_rank(average_rank(both, keys, a, "_ra"), keys, b, "_rb")
    out = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr("_ra", "_rb").alias("rho"))
    if not p_values:
        return out
    rho, dof = F.col("rho"), F.col("n") - 2
    t = F.abs(rho) * F.sqrt(F.try_divide(dof.cast("double"), 1 - rho * rho))
    return out.withColumn("p", F.when(F.abs(rho) >= 1, 0.0).otherwise(column(t_sf2, t, dof.cast("double"))))


def mean_sd_ci(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "", level: float = 0.975) -> DataFrame:
    """Mean, sample sd and Student-t interval over seeds; one seed gives sd 0 and no interval."""
    agg = df.groupBy(*keys).agg(F.count(value).alias("n_seeds"), F.avg(value).alias("_m"),
                                F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd"))
    quant = column(t_ppf, F.lit(level), (F.col("n_seeds") - 1).cast("double"))
    half = F.when(F.col("n_seeds") > 1, quant * F.col("_sd") / F.sqrt(F.col("n_seeds")))
    return agg.select(*keys, "n_seeds", F.col("_m").alias(f"{prefix}mean"), F.col("_sd").alias(f"{prefix}std"),
                      (F.col("_m") - half).alias(f"{prefix}ci_low"), (F.col("_m") + half).alias(f"{prefix}ci_high"))


def significance_counts(tests: DataFrame, keys: Sequence[str] = ("scenario", "A", "B"), alpha: float = 0.05) -> DataFrame:
    """How many seeds reach significance, per pair."""
    return tests.where("p IS NOT NULL").groupBy(*keys).agg(
        F.sum((F.col("p") < alpha).cast("int")).alias("n_sig"), F.count(F.lit(1)).alias("n_seeds_tested"))


def verdict(p: str = "p", alpha: float = 0.05) -> Column:
    """``sig`` / ``ns`` text."""
    return F.when(F.col(p) < alpha, "sig").when(F.col(p).isNotNull(), "ns")
