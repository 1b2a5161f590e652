"""Exact k nearest neighbours in the plane without comparing all pairs.

Points are filed in square cells of doubling size.  A query takes the smallest cell level
at which its own cell holds at least ``k + 1`` points; those lie within one cell diagonal,
so the 3 x 3 block one level up (cells twice as large) is certain to contain the true
neighbours.  Only points of that block are ever compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 24
#: points whose neighbours one task looks for
PROBE_TASK = 4096


def _cell(v: str, size: Column) -> Column:
    return F.floor(F.col(v) / size)


def knn(points: DataFrame, ident: str, x: str, y: str, k: int, base: float, levels: int = LEVELS,
        extra: Sequence[str] = ()) -> DataFrame:
    """(src, dst, dist, rank): the ``k`` nearest other points of every point.

    ``base`` is the edge of the finest cell in the units of x and y.  The coarsest level is
    one cell for everything, so a point with fewer than ``k`` others keeps them all.  Ties
    break by the neighbour's id.  Points sharing one location are kept as they are.  Points are
    filed only up to the level above the first one without a sparse cell: coarser cells hold
    ever larger shares of all points and are never searched.
    """
    pts = points.select(ident, x, y, *extra)

    def at_levels(top: int) -> DataFrame:
        lev = F.explode(F.sequence(F.lit(0), F.lit(top)))
        df = pts.withColumn("lev", lev).withColumn("_s", F.when(F.col("lev") == levels, F.lit(1e300)).otherwise(
            F.lit(float(base)) * F.pow(F.lit(2.0), F.col("lev"))))
        df = df.withColumn("cx", F.when(F.col("lev") == levels, 0).otherwise(_cell(x, F.col("_s"))).cast("bigint"))
        return df.withColumn("cy", F.when(F.col("lev") == levels, 0).otherwise(_cell(y, F.col("_s"))).cast("bigint")).drop("_s")

    def cell_sizes(df: DataFrame) -> DataFrame:
        return df.groupBy("lev", "cx", "cy").agg(F.count(F.lit(1)).alias("_c"))

    seen = cell_sizes(at_levels(levels)).agg(F.max(F.when(F.col("_c") <= k, F.col("lev"))).alias("lev"),
                                             F.sum(F.when(F.col("lev") == 0, F.col("_c"))).alias("n")).first()
    filed = at_levels(min((-1 if seen["lev"] is None else seen["lev"]) + 2, levels))
    # a probe meets many points: the tasks follow the number of probes, not the small bytes sent
    tasks = (seen["n"] or 0) // PROBE_TASK + 1
    counts = cell_sizes(filed)
    level = (filed.join(counts.where(F.col("_c") >= k + 1), ["lev", "cx", "cy"])
             .groupBy(ident).agg(F.min("lev").alias("_l")))
    chosen = pts.join(level, ident, "left").withColumn(
        "lev", F.least(F.coalesce(F.col("_l") + 1, F.lit(levels)), F.lit(levels)))
    size = F.lit(float(base)) * F.pow(F.lit(2.0), F.col("lev"))
    top = F.col("lev") == levels
    near = F.expr("transform(sequence(0, 8), i -> struct(i div 3 - 1 AS dx, i % 3 - 1 AS dy))")
    alone = F.expr("array(struct(0 AS dx, 0 AS dy))")
    probe = chosen.select(
        F.col(ident).alias("src"), F.col(x).alias("_qx"), F.col(y).alias("_qy"), "lev",
        F.when(top, 0).otherwise(_cell(x, size)).cast("bigint").alias("_bx"),
        F.when(top, 0).otherwise(_cell(y, size)).cast("bigint").alias("_by"),
        F.inline(F.when(top, alone).otherwise(near)))
    probe = probe.select("src", "_qx", "_qy", "lev", (F.col("_bx") + F.col("dx")).alias("cx"), (F.col("_by") + F.col("dy")).alias("cy"))
    cand = (probe.repartition(tasks, "lev", "cx", "cy").join(filed.withColumnRenamed(ident, "dst"), ["lev", "cx", "cy"]).where("src <> dst")
            .withColumn("dist", F.sqrt(F.pow(F.col(x) - F.col("_qx"), 2) + F.pow(F.col(y) - F.col("_qy"), 2))))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return cand.select("src", "dst", "dist", rank.alias("rank"), *extra).where(F.col("rank") <= k)
