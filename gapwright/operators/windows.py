"""Sliding count windows over depth, folds, overlap tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import STRIDE, WINDOW
from ..functions.ordered import CHUNK, ordinal
from .cleaning import COLS, complete


def window_starts(idx: str = "idx", size: int = WINDOW, stride: int = STRIDE) -> Column:
    """Array of the starts of every stride-aligned window that covers a sample."""
    first = f"greatest(0, ({idx} - {size} + {stride}) div {stride})"
    return F.expr(f"transform(sequence({first}, {idx} div {stride}), k -> k * {stride})")


def _candidates(samples: DataFrame, size: int, stride: int) -> DataFrame:
    return samples.where(complete() & (F.col("idx") >= 0)).withColumn(
        "start", F.explode(window_starts("idx", size, stride)))


def intact_windows(samples: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(well, start, win_ord) of the windows with every sample and channel measured.

    A window is intact when it holds exactly ``size`` complete samples, so this is one
    map-side-combined count; no ordered pass over a well is needed.
    """
    hit = (_candidates(samples.select("well", "idx", *COLS), size, stride)
           .groupBy("well", "start").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size)
           .select("well", "start").withColumn("_slab", F.expr(f"start div {CHUNK * 16}")))
    return ordinal(hit, ["well"], "_slab", ["start"], "win_ord").select("well", "start", "win_ord")


def window_samples(samples: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Exploded intact windows: (well, start, t, gr, rhob, nphi).

    One shuffle on (well, start); groups hold at most ``size`` rows and later per-window
    operators reuse the same partitioning.
    """
    per = Window.partitionBy("well", "start")
    return (
        _candidates(samples.select("well", "idx", *COLS), size, stride)
        .withColumn("_n", F.count(F.lit(1)).over(per)).where(F.col("_n") == size)
        .select("well", "start", (F.col("idx") - F.col("start")).cast("int").alias("t"), *COLS)
    )


def blocks(samples: DataFrame, aggregates: list[Column], stride: int = STRIDE) -> DataFrame:
    """(well, blk, aggregates) of the stride-aligned blocks with every sample and channel measured.

    Windows overlap but blocks do not: each sample is grouped once, and a window is ``size / stride`` block rows.
    """
    whole = samples.where(complete() & (F.col("idx") >= 0)).withColumn("blk", F.expr(f"idx div {stride}"))
    return whole.groupBy("well", "blk").agg(F.count(F.lit(1)).alias("_n"), *aggregates).where(F.col("_n") == stride).drop("_n")


def by_window(block_rows: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Block rows under the ``start`` of each window they belong to."""
    per = size // stride
    first = f"greatest(0, blk - {per - 1})"
    return block_rows.withColumn("start", F.explode(F.expr(f"transform(sequence({first}, blk), k -> k * {stride})")))


def sample_arrays() -> Column:
    """The samples of a block in depth order, as an aggregate for :func:`blocks`."""
    return F.sort_array(F.collect_list(F.struct("idx", *COLS))).alias("rows")


def window_arrays(block_rows: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Intact windows as one row each: (well, start, a_gr, a_rhob, a_nphi), the arrays indexed by depth position.

    ``block_rows`` are :func:`blocks` with :func:`sample_arrays`.  The number of partitions is fixed: these rows are few and
    small, and the work on each comes after them, so coalescing by bytes would leave cores idle.
    """
    per, width = size // stride, int(block_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = by_window(block_rows.select("well", "blk", "rows"), size, stride).repartition(width, "well", "start")
    whole = parts.groupBy("well", "start").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("blk", "rows"))), lambda x: x["rows"])).alias("rows"))
    return whole.where(F.size("rows") == per * stride).select("well", "start", *[F.col(f"rows.{c}").alias(f"a_{c}") for c in COLS])


def folds(windows: DataFrame) -> DataFrame:
    """Leave-one-well-out folds: (fold_id, test_well), fold order = well order.

    The training side is the predicate ``well <> test_well`` and is never materialised.
    """
    wells = windows.select("well").distinct().withColumn("_slab", _order_slab(windows))
    return ordinal(wells, [], "_slab", ["well"], "fold_id").select("fold_id", F.col("well").alias("test_well"))


def _order_slab(df: DataFrame) -> Column:
    """A key that never decreases along the well order: id ranges, or the first characters."""
    if dict(df.dtypes)["well"] == "string":
        return F.substring("well", 1, 4)
    return F.expr(f"CAST(well AS BIGINT) div {CHUNK}")


def tile_starts(length: str = "length", size: int = WINDOW) -> Column:
    """Half-overlapping window starts that cover a segment, the last one flush with its end."""
    return F.expr(
        f"array_distinct(concat(transform(sequence(0, ({length} - {size}) div {size // 2}), "
        f"k -> CAST(k * {size // 2} AS BIGINT)), array(CAST({length} - {size} AS BIGINT))))")


def tile_segments(segments: DataFrame, size: int = WINDOW) -> DataFrame:
    """(well, seg_start, start): the prediction windows of each intact segment."""
    return segments.select(
        "well", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"),
        F.explode(tile_starts("length", size)).alias("_o")
    ).select("well", "seg_start", "seg_end", (F.col("seg_start") + F.col("_o")).alias("start"))


def overlap_average(pred: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mean prediction over the windows that cover a position."""
    return pred.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])
