"""Ordered-sequence primitives that never put a whole well into one task.

A well may hold a third of all samples, so nothing here windows over a full well.  Every
ordered computation has two levels: a window inside fixed-size chunks (at most
``CHUNK`` rows each) and a window over one small summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536


def with_chunk(df: DataFrame, order: str = "idx", size: int = CHUNK) -> DataFrame:
    """Add the chunk number of each row."""
    return df.withColumn("chunk", F.expr(f"{order} div {size}"))


def ordinal(df: DataFrame, groups: Sequence[str], slab: str, order: Sequence[str | Column],
            name: str) -> DataFrame:
    """Zero-based position of each row inside its group.

    ``slab`` must be non-decreasing along ``order``; rows are numbered inside
    (group, slab) and shifted by the number of rows in the earlier slabs.
    """
    keys = [*groups, slab]
    over_slabs = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0)))
    offsets = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(
            F.sum("_n").over(over_slabs.orderBy(slab).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)))
        .select(*keys, "_before")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (
        df.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_inside", "_before")
    )


def carry(df: DataFrame, groups: Sequence[str], order: str, cols: Sequence[str],
          forward: bool = True, strict: bool = False, prefix: str | None = None) -> DataFrame:
    """Nearest observed value before (or after) each row, over whole groups.

    For every column ``c`` adds ``<prefix>c`` (the closest non-null value along ``order``)
    and ``<prefix>at_c`` (where it was seen).  ``strict`` excludes the row itself.  ``df``
    must carry ``chunk``; what lies outside a row's own chunk comes from one summary row
    per chunk.
    """
    prefix = prefix or ("prev_" if forward else "next_")
    keys = [*groups, "chunk"]
    # running frames only: the backward scan runs over the reversed order
    along = F.col(order) if forward else F.col(order).desc()
    outward = F.col("chunk") if forward else F.col("chunk").desc()
    frame = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    outer = Window.partitionBy(*groups).orderBy(outward).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.max_by if forward else F.min_by
    place = F.max if forward else F.min

    def at(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(order))

    summary = df.groupBy(*keys).agg(*[
        a for c in cols for a in (edge(F.col(c), at(c)).alias(f"_v_{c}"), place(at(c)).alias(f"_a_{c}"))])
    summary = summary.select(*keys, *[
        F.last(f"_{k}_{c}", True).over(outer).alias(f"_o{k}_{c}") for c in cols for k in "va"])
    local = df.select("*", *[
        v for c in cols for v in (F.last(F.col(c), True).over(frame).alias(f"_lv_{c}"),
                                  F.last(at(c), True).over(frame).alias(f"_la_{c}"))])
    out = local.join(summary, keys)
    return out.select(*df.columns, *[
        v for c in cols for v in (F.coalesce(f"_lv_{c}", f"_ov_{c}").alias(prefix + c),
                                  F.coalesce(f"_la_{c}", f"_oa_{c}").alias(f"{prefix}at_{c}"))])


def carry_two(df: DataFrame, groups: Sequence[str], order: str, cols: Sequence[str], forward: bool = True) -> DataFrame:
    """The two nearest observed values before (or after) each row, the row itself excluded, over whole groups.

    For every column ``c`` adds value and position of the nearest one (``by_c, bt_c``) and of the one beyond it
    (``boy_c, bot_c``); with ``forward=False`` the first letter is ``a``.  A chunk's summary is its outermost two; one with
    a single observed value takes its second from the chunks behind it, so summaries chain like rows do.
    """
    side = "b" if forward else "a"
    keys = [*groups, "chunk"]
    frame = Window.partitionBy(*keys).orderBy(F.col(order) if forward else F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge, place = (F.max_by, F.max) if forward else (F.min_by, F.min)

    def at(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(order))

    near = df.select("*", *[x for c in cols for x in (F.last(F.col(c), True).over(frame).alias(f"_ly_{c}"),
                                                      F.last(at(c), True).over(frame).alias(f"_lt_{c}"))])
    local = near.select("*", *[F.last(F.when(F.col(c).isNotNull(), F.col(f"_l{k}_{c}")), True).over(frame).alias(f"_m{k}_{c}")
                               for c in cols for k in "yt"])
    ends = local.groupBy(*keys).agg(*[x for c in cols for x in (
        edge(F.col(c), at(c)).alias(f"_y_{c}"), place(at(c)).alias(f"_t_{c}"),
        edge(F.col(f"_ly_{c}"), at(c)).alias(f"_oy_{c}"), edge(F.col(f"_lt_{c}"), at(c)).alias(f"_ot_{c}"))])
    ends = chain_ends(ends, groups, "chunk", cols, forward)
    out = local.join(ends, keys)
    return out.select(*df.columns, *[
        x for c in cols for k in "yt" for x in (
            F.coalesce(f"_l{k}_{c}", f"_p{k}_{c}").alias(f"{side}{k}_{c}"),
            F.coalesce(f"_m{k}_{c}", F.when(F.col(f"_lt_{c}").isNotNull(), F.col(f"_p{k}_{c}")).otherwise(F.col(f"_q{k}_{c}"))).alias(f"{side}o{k}_{c}"))])


def chain_ends(ends: DataFrame, groups: Sequence[str], chunk: str, cols: Sequence[str], forward: bool = True) -> DataFrame:
    """The two nearest observed values outside each chunk, from one row per chunk with its own outermost two.

    ``ends`` has, per column ``c``, value and position of the outermost one (``_y_c, _t_c``) and of the next one inside
    (``_oy_c, _ot_c``).  Result: groups, chunk, ``_py_c, _pt_c`` (nearest) and ``_qy_c, _qt_c`` (the one beyond).
    """
    outer = Window.partitionBy(*groups).orderBy(F.col(chunk) if forward else F.col(chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("*", *[F.last(f"_{k}_{c}", True).over(outer).alias(f"_p{k}_{c}") for c in cols for k in "yt"])
    return ends.select(*groups, chunk, *[f"_p{k}_{c}" for c in cols for k in "yt"], *[
        F.last(F.when(F.col(f"_t_{c}").isNotNull(), F.coalesce(f"_o{k}_{c}", f"_p{k}_{c}")), True).over(outer).alias(f"_q{k}_{c}")
        for c in cols for k in "yt"])


def chunk_runs(df: DataFrame, groups: Sequence[str], order: str, label: str) -> DataFrame:
    """Maximal runs of a constant non-null label inside each chunk: (label, start, end)."""
    keys = [*groups, "chunk"]
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(label).over(w)
    turn = F.when(before.isNull() | (before != F.col(label)), 1).otherwise(0)
    return (
        df.select(*keys, order, label, turn.alias("_turn"))
        .withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(F.min(label).alias(label), F.min(order).alias("start"), (F.max(order) + 1).alias("end"))
        .drop("_run")
    )


def stitch(runs: DataFrame, groups: Sequence[str], size: int = CHUNK, merge_inside: bool = False) -> DataFrame:
    """Join runs that touch, across chunk borders too.

    All rows of a group carry the same label.  Only runs lying on a chunk border can
    continue in a neighbouring chunk; there are at most two of those per chunk, so the
    window over a whole group sees a bounded summary and never the runs themselves.
    ``merge_inside`` first joins touching runs inside each chunk.
    """
    if merge_inside:
        runs = _merge_touching(runs, [*groups, "chunk"])
    left = F.col("start") == F.col("chunk") * size
    right = F.col("end") == (F.col("chunk") + 1) * size
    cols = [*groups, "start", "end"]
    closed = runs.where(~(left | right)).select(*cols)
    open_ = runs.where(left | right).select(*cols)
    return closed.unionByName(_merge_touching(open_, list(groups)).select(*cols))


def _merge_touching(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start")
    gap = F.when(F.lag("end").over(w) == F.col("start"), 0).otherwise(1)
    return (
        runs.withColumn("_gap", gap)
        .withColumn("_piece", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_piece")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_piece")
    )
