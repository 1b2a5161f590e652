"""By-well cluster bootstrap on additive statistics.

Wells are drawn with replacement, the same draw for both methods of a pair and for every seed.  A multinomial draw over
all wells is split exactly down a binary tree: each node divides its draws between its halves by a binomial seeded by the
node, down to leaves of ``LEAF`` wells with a multinomial inside.  The tree depends on the number of wells alone, so every
size uses the same rule and tasks of any number of leaves agree on every well's multiplicity.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOOTSTRAP_REPS, BOOTSTRAP_SEED
from ..functions.ordered import ordinal
from .metrics import FIELDS
from .windows import _order_slab

LEAF = 64                   # wells of a leaf of the draw
BLOCK = 4096                # wells that one task handles
STEP = 256


def _leaf_totals(n: int, first: int, last: int, reps: int, seed: Sequence[int]) -> dict[int, np.ndarray]:
    """Draws that fall into the leaves ``first`` .. ``last - 1``, for every replicate."""
    out: dict[int, np.ndarray] = {}
    wells = lambda a, b: min(n, b * LEAF) - a * LEAF
    open_ = [(0, -(-n // LEAF), np.full(reps, n))]
    while open_:
        lo, hi, total = open_.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            out[lo] = total
            continue
        mid = (lo + hi) // 2
        left = np.random.default_rng([*seed, lo, hi]).binomial(total, wells(lo, mid) / wells(lo, hi))
        open_ += [(lo, mid, left), (mid, hi, total - left)]
    return out


def _multiplicities(n: int, block: int, size: int, reps: int, seed: int, skip: int):
    """Yield (first replicate, multiplicity matrix) for the wells of one block of ``size``, a multiple of ``LEAF``."""
    first, last = block * size // LEAF, min(-(-n // LEAF), (block + 1) * size // LEAF)
    totals = _leaf_totals(n, first, last, reps, [seed, skip])
    draws = {k: np.random.default_rng([seed, skip, k]) for k in range(first, last)}
    for lo in range(0, reps, STEP):
        yield lo, np.concatenate([draws[k].multinomial(totals[k][lo:lo + STEP], np.full(m, 1.0 / m))
                                  for k in range(first, last) for m in [min(LEAF, n - k * LEAF)]], axis=1)


def resample(suff: DataFrame, pairs: DataFrame, reps: int = BOOTSTRAP_REPS, seed: int = BOOTSTRAP_SEED,
             continued: bool = True, block: int = BLOCK) -> DataFrame:
    """Weighted statistics (scenario, pair_ord, A, B, side, init_seed, mask_seed, log, rep, ...).

    ``pairs`` holds (scenario, pair_ord, A, B).  With ``continued`` every pair has a draw of its own; otherwise all
    pairs share one.
    """
    wells = suff.select("scenario", "well").distinct()
    wells = ordinal(wells.withColumn("_slab", _order_slab(wells)), ["scenario"], "_slab", ["well"], "w_ord")
    wells = wells.select("scenario", "well", "w_ord").join(
        wells.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_wells")), "scenario")
    side = F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("A").alias("method")),
                             F.struct(F.lit("B").alias("side"), F.col("B").alias("method"))))
    want = pairs.select("scenario", "pair_ord", "A", "B", side.alias("_s")).select(
        "scenario", "pair_ord", "A", "B", "_s.side", "_s.method")
    rows = (suff.join(want, ["scenario", "method"]).join(wells, ["scenario", "well"])
            .select("scenario", "pair_ord", "A", "B", "side", "init_seed", "mask_seed", "log", "w_ord", "n_wells",
                    F.expr(f"w_ord div {block}").alias("block"),
                    *[F.col(f).cast("double").alias(f) for f in FIELDS[:4]]))
    cell = ["scenario", "pair_ord", "A", "B", "side", "init_seed", "mask_seed", "log"]
    schema = ("scenario string, pair_ord int, A string, B string, side string, init_seed int, mask_seed int, log string, "
              "rep int, n double, sum_y double, sum_y2 double, sse double")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        b, n, p = int(pdf["block"].iat[0]), int(pdf["n_wells"].iat[0]), int(pdf["pair_ord"].iat[0])
        m = min(block, n - b * block)
        cells = [(k, g) for k, g in pdf.groupby(cell, sort=True)]
        dense = np.zeros((m, len(cells) * 4))
        for j, (_, g) in enumerate(cells):
            dense[(g["w_ord"] - b * block).to_numpy(), 4 * j:4 * j + 4] = g[FIELDS[:4]].to_numpy()
        sums = np.concatenate([w @ dense for _, w in _multiplicities(n, b, block, reps, seed, p if continued else 0)])
        parts = []
        for j, (k, _) in enumerate(cells):
            part = pd.DataFrame(sums[:, 4 * j:4 * j + 4], columns=FIELDS[:4])
            part.insert(0, "rep", np.arange(reps))
            for name, v in reversed(list(zip(cell, k))):
                part.insert(0, name, v)
            parts.append(part)
        return pd.concat(parts)

    drawn = rows.groupBy("block", "scenario", "pair_ord").applyInPandas(draw, schema)
    return drawn.groupBy(*cell, "rep").agg(*[F.sum(f).alias(f) for f in FIELDS[:4]])


def _r2() -> Column:
    sst = F.col("sum_y2") - F.col("sum_y") * F.col("sum_y") / F.col("n")
    return F.when((F.col("n") > 1) & (sst > 0), 1 - F.col("sse") / sst)


def _score(stats: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Macro R2 (mean of three logs, NULL unless all) or pooled R2 over all logs together."""
    seeds = ["init_seed", "mask_seed"]
    if metric == "macro":
        per = stats.withColumn("r2", F.when(F.col("n") > 0, _r2()))
        return per.groupBy(*keys, *seeds).agg(F.when(F.count("r2") == 3, F.avg("r2")).alias("score"))
    merged = stats.groupBy(*keys, *seeds).agg(*[F.sum(f).alias(f) for f in FIELDS[:4]])
    return merged.select(*keys, *seeds, F.when(F.col("n") > 0, _r2()).alias("score"))


def _delta(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Difference A - B, averaged over seeds."""
    seeds = ["init_seed", "mask_seed"]
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("score")))
    per = scored.groupBy(*keys, *seeds).agg((pick("A") - pick("B")).alias("_d"))
    return per.groupBy(*keys).agg(F.when(F.count("_d") == F.count(F.lit(1)), F.avg("_d")).alias("delta"))


def delta_bootstrap(suff: DataFrame, pairs: DataFrame, metric: str = "macro", reps: int = BOOTSTRAP_REPS,
                    seed: int = BOOTSTRAP_SEED, continued: bool = True, floor: bool = False, block: int = BLOCK) -> DataFrame:
    """Paired bootstrap of the score difference: point estimate, 95 % interval, two-sided p.

    ``floor=False``: p = 2 min(P(d<=0), P(d>=0)) capped at 1.  ``floor=True``: p = 2 min(f, 1-f)
    with f = P(d>0), not below 1/reps.
    """
    key = ["scenario", "pair_ord", "A", "B"]
    point = delta_point(suff, pairs, metric)
    drawn = resample(suff, pairs, reps, seed, continued, block)
    deltas = _delta(_score(drawn, [*key, "side", "rep"], metric), [*key, "rep"])
    share = lambda c: F.avg(F.coalesce(c.cast("double"), F.lit(0.0)))
    d = F.col("delta")
    agg = deltas.groupBy(*key).agg(
        F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"),
        share(d <= 0).alias("_le"), share(d >= 0).alias("_ge"), share(d > 0).alias("_gt"))
    p = (F.greatest(2 * F.least(F.col("_gt"), 1 - F.col("_gt")), F.lit(1.0 / reps)) if floor
         else F.least(F.lit(1.0), 2 * F.least("_le", "_ge")))
    return agg.join(point, key).select(*key, "delta", F.col("_ci")[0].alias("ci_lo"), F.col("_ci")[1].alias("ci_hi"),
                                       p.alias("p_boot"))


def delta_point(suff: DataFrame, pairs: DataFrame, metric: str = "macro") -> DataFrame:
    """Score difference of every pair over all wells, without resampling."""
    key = ["scenario", "pair_ord", "A", "B"]
    side = F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("A").alias("method")),
                             F.struct(F.lit("B").alias("side"), F.col("B").alias("method"))))
    want = pairs.select(*key, side.alias("_s")).select(*key, "_s.side", "_s.method")
    whole = suff.join(want, ["scenario", "method"]).groupBy(*key, "side", "init_seed", "mask_seed", "log").agg(
        *[F.sum(f).alias(f) for f in FIELDS[:4]])
    return _delta(_score(whole, [*key, "side"], metric), key)


def r2_bootstrap(suff: DataFrame, cells: DataFrame, reps: int = 5000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """95 % interval of the pooled R2 per (method, scenario).

    ``cells`` holds (scenario, method, pair_ord); ``pair_ord`` is the position of the
    scenario in the method's generator stream.
    """
    pairs = cells.select("scenario", "pair_ord", F.col("method").alias("A"), F.lit(None).cast("string").alias("B"))
    key = ["scenario", "A"]
    whole = suff.join(cells, ["scenario", "method"]).withColumnRenamed("method", "A").groupBy(
        *key, "init_seed", "mask_seed", "log").agg(*[F.sum(f).alias(f) for f in FIELDS[:4]])
    point = _score(whole, key, "pooled").groupBy(*key).agg(F.avg("score").alias("r2"))
    drawn = _score(resample(suff, pairs.withColumn("B", F.lit("")), reps, seed, True, block), [*key, "rep"], "pooled")
    per = drawn.groupBy(*key, "rep").agg(F.avg("score").alias("score"))
    agg = per.groupBy(*key).agg(F.percentile("score", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"),
                                F.avg("score").alias("boot_mean"), F.stddev_pop("score").alias("boot_sd"))
    return agg.join(point, key).select(
        F.col("A").alias("method"), "scenario", "r2", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"),
        "boot_mean", "boot_sd")


def misaligned(points: DataFrame, a: str, b: str, tol: float = 1e-3) -> DataFrame:
    """Positions where two methods disagree on the truth or that only one of them scored."""
    pos = ["scenario", "init_seed", "mask_seed", "log", "well", "start", "t"]
    left = points.where(F.col("method") == a).select(*pos, F.col("truth").alias("ta"))
    right = points.where(F.col("method") == b).select(*pos, F.col("truth").alias("tb"))
    return left.join(right, pos, "full").where(
        F.col("ta").isNull() | F.col("tb").isNull() | (F.abs(F.col("ta") - F.col("tb")) > tol))
