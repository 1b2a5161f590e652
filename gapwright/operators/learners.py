"""Tree and nearest-neighbour imputers: one regressor per channel from the other channels.

Models are fitted per held-out well on all other wells' windows with Spark ML; a fold is one
distributed fit.  Tree ensembles follow the same settings as the reference family but not its
random streams, so scores agree in distribution, not bit for bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BOOSTED, FOREST, KNN_K
from .cleaning import COLS
from .scaling import others

KINDS = ("rf", "xgb", "xgb_miss", "xgb_chain_asc", "xgb_chain_desc")


def _regressor(kind: str, seed: int, **over):
    if kind == "rf":
        return RandomForestRegressor(featuresCol="features", labelCol="label", seed=seed, featureSubsetStrategy="all",
                                     **{"maxDepth": 30, **FOREST, **over})
    return GBTRegressor(featuresCol="features", labelCol="label", seed=seed, **{**BOOSTED, **over})


class TreeImputer:
    """``kind``: rf, xgb (fitted on intact rows), xgb_miss (fitted on corrupted predictors with
    missing indicators), xgb_chain_asc / _desc (in channel order / reversed).  Every kind predicts the channels in turn and
    reads its own predictions for the ones before.  ``rf`` stops at depth 30, the ceiling of Spark ML."""

    def __init__(self, kind: str = "rf", seed: int = 0, **over):
        if kind not in KINDS:
            raise ValueError(kind)
        self.kind, self.seed, self.over, self.models = kind, seed, over, {}

    def _features(self, c: str) -> list[str]:
        f = [f"f_{o}" for o in others(c)]
        return f + [f"o_{o}" for o in others(c)] if self.kind == "xgb_miss" else f

    def fit(self, train: DataFrame, scale_cols: DataFrame) -> TreeImputer:
        """``train``: window rows (truth columns, ``x_<log>`` for xgb_miss); ``scale_cols``: one row mu/sd."""
        z = _with_scale(train, scale_cols)
        for c in COLS:
            src = "x_" if self.kind == "xgb_miss" else ""
            rows = z.select(((F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")).alias("label"), *_inputs(c, src))
            if self.kind == "xgb_miss":
                rows = rows.where(" OR ".join(f"o_{o} > 0" for o in others(c)))
            vec = VectorAssembler(inputCols=self._features(c), outputCol="features").transform(rows.where("label IS NOT NULL"))
            self.models[c] = _regressor(self.kind, self.seed, **self.over).fit(vec.select("label", "features"))
        return self

    def predict(self, masked: DataFrame, scale_cols: DataFrame) -> DataFrame:
        """Masked rows with ``p_<kind>_<log>`` in physical units."""
        keep = [c for c in masked.columns if not c.startswith("x_")]
        df = _with_scale(masked.where("mask_bits > 0"), scale_cols)
        order = COLS[::-1] if self.kind.endswith("desc") else COLS
        state = {c: f"x_{c}" for c in COLS}
        for c in order:
            df = df.select("*", *_inputs(c, "x_", state))
            df = VectorAssembler(inputCols=self._features(c), outputCol="features").transform(df)
            df = self.models[c].transform(df).withColumn(f"p_{self.kind}_{c}", F.col("prediction") * F.col(f"sd_{c}") + F.col(f"mu_{c}"))
            df = df.drop("features", "prediction", *[f"{k}_{o}" for k in "fo" for o in others(c)])
            df = df.withColumn(f"s_{c}", F.coalesce(f"x_{c}", f"p_{self.kind}_{c}"))
            state[c] = f"s_{c}"
        return df.select(*keep, *[f"p_{self.kind}_{c}" for c in COLS])


def _inputs(c: str, prefix: str, state: dict[str, str] | None = None) -> list[Column]:
    out = []
    for o in others(c):
        v = F.col(state[o] if state else f"{prefix}{o}")
        out += [F.coalesce((v - F.col(f"mu_{o}")) / F.col(f"sd_{o}"), F.lit(0.0)).alias(f"f_{o}"),
                v.isNotNull().cast("double").alias(f"o_{o}")]
    return out


def _with_scale(df: DataFrame, one_row: DataFrame) -> DataFrame:
    from .masking import _with_scalar
    return _with_scalar(df, one_row)


def knn_impute(queries: DataFrame, train: DataFrame, target: str, k: int = KNN_K, cell: float = 0.05,
               levels: int = 12) -> DataFrame:
    """Inverse-distance mean of the ``k`` nearest training rows of other wells.

    ``queries``: (qid, well, za, zb) and ``train``: (well, start, t, za, zb, target) in one
    common standardisation.  Equal feature points are collapsed first: of each point at most
    ``k`` rows per well and ``2k`` in all can ever be needed, whoever is excluded.  Points are
    filed in cells of doubling size; a query uses the first level whose own cell holds enough
    rows of other wells, then searches the 3 x 3 block one level up, which provably holds the
    answer.  A zero distance makes the exact matches the only ones that count.
    """
    order = Window.partitionBy("za", "zb", "well").orderBy("start", "t")
    per_well = train.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    top = Window.partitionBy("za", "zb").orderBy("well", "start", "t")
    pool = per_well.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= 2 * k).drop("_r")
    size = F.when(F.col("lev") == levels, F.lit(1e300)).otherwise(cell * F.pow(F.lit(2.0), F.col("lev")))
    grid = lambda v: F.when(F.col("lev") == levels, 0).otherwise(F.floor(F.col(v) / size)).cast("bigint")
    filed = pool.withColumn("lev", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("cx", grid("za")).withColumn("cy", grid("zb"))
    total = filed.groupBy("lev", "cx", "cy").agg(F.count(F.lit(1)).alias("_n"))
    own = filed.groupBy("lev", "cx", "cy", "well").agg(F.count(F.lit(1)).alias("_own"))
    q = queries.withColumn("lev", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("cx", grid("za")).withColumn("cy", grid("zb"))
    level = (q.join(total, ["lev", "cx", "cy"]).join(own, ["lev", "cx", "cy", "well"], "left")
             .where(F.col("_n") - F.coalesce("_own", F.lit(0)) >= k).groupBy("qid").agg(F.min("lev").alias("_l")))
    chosen = queries.join(level, "qid", "left").withColumn("lev", F.least(F.coalesce(F.col("_l") + 1, F.lit(levels)), F.lit(levels)))
    near = F.when(F.col("lev") == levels, F.expr("array(struct(0 AS dx, 0 AS dy))")).otherwise(
        F.expr("transform(sequence(0, 8), i -> struct(i div 3 - 1 AS dx, i % 3 - 1 AS dy))"))
    probe = chosen.withColumn("bx", grid("za")).withColumn("by", grid("zb")).select(
        "qid", F.col("well").alias("qw"), F.col("za").alias("qa"), F.col("zb").alias("qb"), "lev", "bx", "by", F.inline(near)).select(
        "qid", "qw", "qa", "qb", "lev", (F.col("bx") + F.col("dx")).alias("cx"), (F.col("by") + F.col("dy")).alias("cy"))
    cand = probe.join(filed, ["lev", "cx", "cy"]).where("well <> qw").withColumn(
        "d", F.sqrt(F.pow(F.col("za") - F.col("qa"), 2) + F.pow(F.col("zb") - F.col("qb"), 2)))
    w = Window.partitionBy("qid").orderBy("d", "well", "start", "t")
    best = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    hit = F.col("d") == 0
    exact = F.avg(F.when(hit, F.col(target)))
    inv = F.when(~hit, 1.0 / F.col("d"))
    return best.groupBy("qid").agg(F.coalesce(exact, F.try_divide(F.sum(inv * F.col(target)), F.sum(inv))).alias("pred"))


def train_rows(ws: DataFrame, held_out: Sequence) -> DataFrame:
    """Window rows of the training wells of one fold."""
    return ws.where(~F.col("well").isin(*held_out))
