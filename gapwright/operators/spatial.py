"""Well graph, shared depth grid, same-depth spatial interpolation, variograms, kriging.

Sums over "all wells measured at this depth" are dense products of a weight matrix and a
depth grid, so they run as tiles: (target block, source block, depth block) is one task of
bounded size, partial results are added across source blocks, and no well pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import GRAPH_K, IDW_MIN_KM, SHUFFLE_SEED_BASE, STEP_M, VARIOGRAM_GRID, WINDOW
from ..functions.neighbours import knn
from ..functions.ordered import ordinal
from .cleaning import COLS
from ..session import cut_lineage, released
from .masking import _with_scalar
from .windows import _order_slab

WELL_BLOCK = 256
DEPTH_BLOCK = 256
#: blocks into which the wells of a pair query are cut, the wells a block holds at most, and cells of a tile worked on together
PAIR_BLOCKS = 8
PAIR_BLOCK = 4096
PAIR_ROWS = 1 << 18
#: target wells and depths of a tile of the same-depth estimates (few blocks, so a source is copied to few of them), sources
#: looked at together, and targets worked on together
TARGET_BLOCK = 262_144
SOURCE_BLOCK = 65_536
LAYER = 16
TARGET_ROWS = 1 << 15
#: points in a batch of results
POINT_ROWS = 1 << 16
#: depths of a row of a graph aggregation
MESSAGE_LAYER = 64
CELL_M = 500.0


# --- identifiers and coordinates -----------------------------------------------------------

def normalise_id(col, aliases: dict[str, str] | None = None):
    """Canonical well identifier: upper case, archive suffix and separators collapsed."""
    c = F.upper(col)
    c = F.regexp_replace(c, r"-?14-\d+.*$", "")
    c = F.regexp_replace(c, "_", "-")
    c = F.regexp_replace(F.regexp_replace(c, "-+", "-"), "^-+|-+$", "")
    c = F.regexp_replace(c, r"(\d+)D\b", "$1")
    c = F.regexp_replace(c, r"\bSS\b", "SOUS")
    for src, dst in (aliases or {}).items():
        c = F.replace(c, F.lit(src.upper()), F.lit(dst.upper()))
    return c


def match_coords(wells: DataFrame, table: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(well, x, y) by normalised identifier; a well without coordinates is an error."""
    left = wells.select("well", normalise_id(F.col("well").cast("string"), aliases).alias("_key"))
    right = table.groupBy(normalise_id(F.col("name"), aliases).alias("_key")).agg(
        F.last("x").alias("x"), F.last("y").alias("y"))
    lost = F.raise_error(F.concat(F.lit("no coordinates for well "), F.col("well").cast("string"))).cast("double")
    return left.join(right, "_key", "left").select(
        "well", F.when(F.col("x").isNull(), lost).otherwise(F.col("x")).alias("x"), "y")


# --- graph ------------------------------------------------------------------------------------

def knn_edges(coords: DataFrame, k: int = GRAPH_K, cell_m: float = CELL_M) -> DataFrame:
    """(src, dst, d_km, rank): the ``k`` nearest other wells of every well."""
    return knn(coords, "well", "x", "y", k, cell_m).select(
        "src", "dst", (F.col("dist") / 1000.0).alias("d_km"), "rank")


def median_distance(coords: DataFrame, grid: int = 64, most: int = 1 << 18) -> DataFrame:
    """One row ``scale_km``: the median of the strictly positive pairwise distances, exactly.

    Wells are counted in a raster of square cells over their bounding box: ``grid`` x ``grid`` cells for few wells, about one
    cell a well for many, ``most`` at most.  Pair counts per cell offset bracket the median; only pairs in cell offsets that
    straddle the bracket are measured, all other pairs are counted without being formed.
    """
    spark = coords.sparkSession
    box = coords.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"),
                     (F.max("y") - F.min("y")).alias("v"), F.count("x").alias("n")).first()
    wide, high = (max(float(box[k] or 0.0), 1e-9) for k in "wv")
    room = min(max(box["n"], grid * grid), most)
    # the cell edge at which the box holds ``room`` cells, not counting the partial ones at its borders
    h = max(np.sqrt(wide * high / room), max(wide, high) / room) * (1 + 1e-9)
    nx, ny = (int(np.floor(k / h)) + 1 for k in (wide, high))
    cells = coords.select("well", "x", "y", F.floor((F.col("x") - box["x0"]) / h).cast("int").alias("cx"),
                          F.floor((F.col("y") - box["y0"]) / h).cast("int").alias("cy"))
    raster = np.zeros((nx, ny))
    for r in cells.groupBy("cx", "cy").count().collect():   # at most nx * ny rows
        raster[r["cx"], r["cy"]] = r["count"]
    spec = np.fft.rfft2(raster, (2 * nx, 2 * ny))
    auto = np.rint(np.fft.irfft2(spec * np.conj(spec), (2 * nx, 2 * ny)))
    auto[0, 0] -= raster.sum()
    ox, oy = np.meshgrid(*(np.rint(np.fft.fftfreq(2 * k, 1 / (2 * k))).astype(int) for k in (nx, ny)), indexing="ij")
    dx, dy = np.abs(ox), np.abs(oy)
    lo = np.hypot(np.maximum(dx - 1, 0), np.maximum(dy - 1, 0)) * h
    hi = np.hypot(dx + 1, dy + 1) * h
    same = coords.groupBy("x", "y").count().agg(F.sum(F.col("count") * (F.col("count") - 1)).alias("z")).first()["z"] or 0
    n_pos = auto.sum() - same                       # ordered pairs at a positive distance
    if n_pos <= 0:
        return spark.createDataFrame([(None,)], "scale_km double")
    k_lo, k_hi = (n_pos - 1) // 2 + same, n_pos // 2 + same
    live = auto > 0
    sure = lambda edge, k: edge[live][np.argsort(edge[live], kind="stable")][
        np.searchsorted(np.cumsum(auto[live][np.argsort(edge[live], kind="stable")]), k, side="right")]
    t_lo, t_hi = sure(lo, k_lo), sure(hi, k_hi)       # the median lies in [t_lo, t_hi]
    below = auto[live & (hi < t_lo)].sum()
    straddle = live & (hi >= t_lo) & (lo <= t_hi)
    offsets = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ox[straddle], oy[straddle])], "ox int, oy int")
    occupied = cells.select("cx", "cy").distinct()
    near = (occupied.withColumn("_one", F.lit(1)).join(offsets.withColumn("_one", F.lit(1)), "_one")
            .select("cx", "cy", (F.col("cx") + F.col("ox")).alias("bx"), (F.col("cy") + F.col("oy")).alias("by"))
            .join(occupied.toDF("bx", "by"), ["bx", "by"]))
    other = cells.select(F.col("well").alias("w2"), F.col("x").alias("x2"), F.col("y").alias("y2"),
                         F.col("cx").alias("bx"), F.col("cy").alias("by"))
    pairs = cells.join(near, ["cx", "cy"]).join(other, ["bx", "by"]).where("well <> w2").select(
        F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)).alias("d"))
    from ..functions.ranks import rank_table
    ranks = rank_table(pairs, [], "d")
    at = lambda k: F.max(F.when((F.col("below") <= k - below) & (k - below < F.col("below") + F.col("cnt")), F.col("d")))
    return ranks.agg(((at(float(k_lo)) + at(float(k_hi))) / 2 / 1000.0).alias("scale_km"))


def adjacency(edges: DataFrame, scale: DataFrame, self_loop: bool = True) -> DataFrame:
    """Row-normalised Gaussian weights of the neighbour graph, self weight 1 included."""
    w = _with_scalar(edges, scale).select(
        "src", "dst", "d_km", F.exp(-(F.col("d_km") * F.col("d_km")) / (2 * F.col("scale_km") * F.col("scale_km"))).alias("w"))
    if self_loop:
        loops = edges.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0.0).alias("d_km"), F.lit(1.0).alias("w"))
        w = w.unionByName(loops)
    total = w.groupBy("src").agg((F.sum("w") + 1e-8).alias("_t"))
    return w.join(total, "src").select("src", "dst", "d_km", (F.col("w") / F.col("_t")).alias("weight"))


def identity_graph(coords: DataFrame) -> DataFrame:
    """No-neighbour control: self loops only."""
    return coords.select(F.col("well").alias("src"), F.col("well").alias("dst"), F.lit(0.0).alias("d_km"), F.lit(1.0).alias("weight"))


def shuffled_coords(coords: DataFrame, seed: int = 0) -> DataFrame:
    """Coordinates permuted over the wells: same graph construction, no geography."""
    slab = _order_slab(coords)
    pos = ordinal(coords.withColumn("_slab", slab), [], "_slab", ["well"], "pos")
    draw = F.xxhash64(F.lit(SHUFFLE_SEED_BASE + seed), F.col("well"))
    perm = ordinal(coords.select("x", "y", draw.alias("_h"), F.pmod(draw, F.lit(1024)).alias("_slab")), [], "_slab",
                   ["_slab", "_h", "x", "y"], "pos").select("pos", "x", "y")
    return pos.select("well", "pos").join(perm, "pos").select("well", "x", "y")


def message_pass(features: DataFrame, weights: DataFrame, cols: list[str], tile: int = WELL_BLOCK, layer: int = MESSAGE_LAYER) -> DataFrame:
    """One graph aggregation: weighted sum of the neighbours' features at the same position ``g``.

    Targets are taken in tiles of ``tile`` consecutive wells and layers of ``layer`` positions.  A well's layer is one row of
    arrays, sent once to each tile that has a target beside it, with its weights for all targets of the tile.
    """
    def numbered(name: str) -> DataFrame:
        w = weights.select(F.col("src").alias("well")).distinct()
        w = ordinal(w.withColumn("_slab", _order_slab(w)), [], "_slab", ["well"], "_ord")
        return w.select(F.col("well").alias(name), F.expr(f"_ord div {tile}").alias("tb"))

    near = weights.join(numbered("src"), "src").groupBy("tb", F.col("dst").alias("well")).agg(
        F.collect_list("src").alias("src"), F.collect_list(F.coalesce("weight", F.lit(float("nan")))).alias("weight"))
    packed = features.groupBy("well", F.expr(f"g div {layer}").alias("db")).agg(F.collect_list(F.struct("g", *cols)).alias("r"))
    packed = packed.select("well", "db", F.col("r.g").alias("g"), *[F.col(f"r.{c}").alias(c) for c in cols])
    sent = near.join(packed, "well").select("tb", "db", "src", "weight", "g", *cols)
    kind_t = dict(weights.dtypes)["src"]

    def total(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        lists = {k: t[k].chunk(0) for k in ("src", "weight", "g", *cols)}
        sizes = {k: lists[k].value_lengths().to_numpy() for k in ("src", "g")}
        names = lists["src"].flatten().dictionary_encode()
        who, w = names.indices.to_numpy(), lists["weight"].flatten().to_numpy()
        start = np.cumsum(sizes["g"]) - sizes["g"]
        # every edge meets every position of its neighbour's row
        row = np.repeat(np.arange(t.num_rows), sizes["src"])
        times = sizes["g"][row]
        edge = np.repeat(np.arange(len(row)), times)
        at = np.arange(len(edge)) - np.repeat(np.cumsum(times) - times - start[row], times)
        g = lists["g"].flatten().to_numpy()
        low, width = int(g.min()), int(g.max() - g.min()) + 1      # at most ``layer`` positions
        place = who[edge] * width + (g - low)[at]
        size = len(names.dictionary) * width
        found = np.flatnonzero(np.bincount(place, minlength=size))
        out = {"well": names.dictionary.take(pa.array(found // width)), "g": pa.array(found % width + low)}
        for c in cols:
            values = lists[c].flatten()
            part = w[edge] * values.to_numpy(zero_copy_only=False)[at]
            if values.null_count or np.isnan(w).any():
                known = values.is_valid().to_numpy(zero_copy_only=False)[at] & ~np.isnan(w)[edge]
                some = np.bincount(place[known], minlength=size)[found] > 0
                part[~known] = 0.0
            else:
                some = np.ones(len(found), bool)
            out[c] = pa.array(np.bincount(place, weights=part, minlength=size)[found], mask=~some)
        return pa.table(out)

    return sent.groupBy("tb", "db").applyInArrow(total, f"well {kind_t}, g bigint, " + ", ".join(f"{c} double" for c in cols))


# --- shared depth grid --------------------------------------------------------------------------

def grid_offsets(samples: DataFrame, step: float = STEP_M) -> DataFrame:
    """(well, offset, length) of each well on the shared axis, and its total size ``d_tot``."""
    per = samples.groupBy("well").agg(F.min_by("depth", "idx").alias("top"), F.max_by("depth", "idx").alias("base"),
                                      (F.max("idx") + 1).alias("length"))
    box = per.agg(F.min("top").alias("d0"), F.max("base").alias("d_end"))
    return _with_scalar(per, box).select(
        "well", F.bround((F.col("top") - F.col("d0")) / step).cast("bigint").alias("offset"), "length",
        (F.bround((F.col("d_end") - F.col("d0")) / step) + 1).cast("bigint").alias("d_tot"))


def on_grid(samples: DataFrame, offsets: DataFrame, *extra: Column) -> DataFrame:
    """Samples with their integer position ``g`` on the shared axis (no padding rows)."""
    return samples.join(offsets.select("well", "offset"), "well").select(
        "well", "idx", (F.col("idx") + F.col("offset")).alias("g"), *COLS, *extra)


def _fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so a frame can be cogrouped with a relative."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


# --- tiled same-depth interpolation ----------------------------------------------------------------

def _alike(has: np.ndarray) -> list[np.ndarray]:
    """Groups of equal columns."""
    _, of = np.unique(np.packbits(has, axis=0), axis=1, return_inverse=True)
    of = of.reshape(-1)
    return np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])


def _weighted_cells(t_km: np.ndarray, s_km: np.ndarray, own: np.ndarray, values: np.ndarray,
                    rows: int = 256, cols: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Sums of value / distance^2 and of 1 / distance^2 per (target, column) over the sources measured in the column."""
    width = values.shape[1]
    has = np.isfinite(values)
    alike = _alike(has)                                   # columns measured in the same sources share their weights
    both = np.hstack([np.where(has, values, 0.0), has[:, [c[0] for c in alike]]])
    out = np.zeros((len(t_km), both.shape[1]))
    for i in range(0, len(t_km), rows):
        tx, ty, me = t_km[i:i + rows, :1], t_km[i:i + rows, 1:], own[i:i + rows]
        for j in range(0, len(s_km), cols):
            w, dy = tx - s_km[j:j + cols, 0], ty - s_km[j:j + cols, 1]
            w *= w
            dy *= dy
            w += dy
            np.maximum(w, IDW_MIN_KM ** 2, out=w)
            np.reciprocal(w, out=w)
            here = np.flatnonzero((me >= j) & (me < j + cols))
            w[here, me[here] - j] = 0.0
            out[i:i + rows] += w @ both[j:j + cols]
    den = np.empty((len(t_km), width))
    for k, c in enumerate(alike):
        den[:, c] = out[:, [width + k]]
    return out[:, :width], den


def _nearest_cells(t_km: np.ndarray, s_km: np.ndarray, own: np.ndarray, values: np.ndarray,
                   rows: int = 256, first: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Value and distance of the nearest other source measured in the column, per (target, column).

    Targets are taken in compact groups of ``rows``.  A group looks among the sources nearest to its bounding box; a cell is
    settled when its best distance is below that of every source not yet looked at, the others look among four times as many.
    """
    width = values.shape[1]
    has = np.isfinite(values)
    num, den = np.full((len(t_km), width), np.nan), np.full((len(t_km), width), np.inf)
    side = max(int(np.sqrt(len(t_km) / rows)), 1)
    strip = np.argsort(np.argsort(t_km[:, 0], kind="stable"), kind="stable") * side // max(len(t_km), 1)
    order = np.lexsort((t_km[:, 1], strip))
    for i in range(0, len(order), rows):
        group = order[i:i + rows]
        low, high = t_km[group].min(axis=0), t_km[group].max(axis=0)
        away = np.hypot(*np.maximum(np.maximum(low - s_km, s_km - high), 0.0).T)
        by = np.argsort(away, kind="stable")
        todo, take = np.ones((len(group), width), bool), min(first, len(by))
        while True:
            look = np.sort(by[:take])
            beyond = away[by[take]] if take < len(by) else np.inf
            live = np.flatnonzero(todo.any(axis=1))
            who = group[live]
            d = np.hypot(t_km[who, :1] - s_km[look, 0], t_km[who, 1:] - s_km[look, 1])
            d[own[who][:, None] == look] = np.inf
            open_ = np.flatnonzero(todo.any(axis=0))
            for cells in _alike(has[np.ix_(look, open_)]):
                c = open_[cells]
                there = look[has[look, c[0]]]
                if not len(there):
                    continue
                part = d if len(there) == len(look) else d[:, has[look, c[0]]]
                j = part.argmin(axis=1)
                got = part[np.arange(len(who)), j]
                r, k = np.nonzero(todo[np.ix_(live, c)] & np.isfinite(got)[:, None])
                num[who[r], c[k]], den[who[r], c[k]] = values[there[j[r]], c[k]], got[r]
                todo[np.ix_(live[got < beyond], c)] = False
            if take == len(by) or not todo.any():
                break
            # a column whose measured sources have all been seen is settled too
            todo[:, ~has[by[take:]].any(axis=0)] = False
            if not todo.any():
                break
            take = min(take * 4, len(by))
    return num, den


def _depth_layers(grid: DataFrame, layer: int) -> DataFrame:
    """Grid rows that carry ``x, y, w_ord`` of their well as rows of arrays by layer of ``layer`` depths; nothing is shuffled.

    Output: well, x, y, w_ord, db and lists of the positions in the layer and of the channels there.  A well's layer may come in
    several rows.  ``hidden`` marks rows of the grid that only tell the truth.
    """
    values = [*COLS, *[c for c in ("hidden",) if c in grid.columns]]
    kind = grid.schema["well"].dataType
    schema = T.StructType([T.StructField("well", kind), *T._parse_datatype_string(
        "x double, y double, w_ord bigint, db bigint, g array<smallint>, " + ", ".join(f"{c} array<{'boolean' if c == 'hidden' else 'double'}>" for c in values)).fields])

    def layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in filter(len, batches):
            g, well = rb.column("g").to_numpy(), rb.column("well").dictionary_encode().indices.to_numpy()
            order = np.lexsort((g, well))
            rb, g, well = rb.take(pa.array(order)), g[order], well[order]
            db = g // layer
            first = np.flatnonzero(np.r_[True, (db[1:] != db[:-1]) | (well[1:] != well[:-1])])
            ends = pa.array(np.r_[first, len(g)].astype("int32"))
            head = rb.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([
                *[head.column(k) for k in ("well", "x", "y", "w_ord")], pa.array(db[first]),
                pa.ListArray.from_arrays(ends, pa.array((g - db * layer).astype("int16"))),
                *[pa.ListArray.from_arrays(ends, rb.column(c)) for c in values]], schema.names)

    rows = grid.where("g IS NOT NULL").select("well", "x", "y", "w_ord", "g", *[F.col(c).cast("double").alias(c) for c in COLS], *values[len(COLS):])
    return rows.mapInArrow(layers, schema)


def _tiled(targets: DataFrame, grid: DataFrame, coords: DataFrame, kind: str, emit, schema: T.StructType, told: bool = False,
           hide: bool = False) -> DataFrame:
    """Estimates of target rows (well, db, ...) from all other wells, a tile (target block, depth layer) at a time.

    The blocks of sources of a tile follow each other in one task, which holds the sums of its targets and one block of sources;
    only then ``emit`` turns the target rows into results, so no estimate is shuffled.  ``emit`` gets the tile, its target rows, the
    well of each among the tile's, and per well, channel and depth the estimate (NaN: no other well there) and, if ``told``, the
    measured value.
    """
    if kind not in ("idw", "nnwell"):
        raise ValueError(kind)
    layer, block, step = LAYER, TARGET_BLOCK, TARGET_ROWS
    one = coords.groupBy("well").agg(F.min(F.struct("x", "y")).alias("p")).select("well", "p.x", "p.y")
    nb = ordinal(one.withColumn("_slab", _order_slab(one)), [], "_slab", ["well"], "w_ord").select("well", "x", "y", "w_ord")
    last = nb.agg(F.expr(f"max(w_ord) div {block}").alias("last"))
    src = _with_scalar(_depth_layers(grid.join(nb, "well"), layer), last).withColumn("tb", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
    src = src.drop("well", "last").withColumn("side", F.lit(1)).withColumn("sb", F.expr(f"w_ord div {SOURCE_BLOCK}"))
    # a target without coordinates has no estimate: its block -1 has no sources
    tgt = targets.join(nb, "well", "left").withColumn("tb", F.expr(f"coalesce(w_ord div {block}, -1L)")).withColumn("side", F.lit(0)).withColumn("sb", F.lit(-1).cast("bigint"))
    width = 4 * int(coords.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tb", "db", "side", "sb"]
    sent = tgt.unionByName(src, allowMissingColumns=True).repartition(width, "tb", "db").sortWithinPartitions(*keys)
    estimate = _nearest_cells if kind == "nnwell" else _weighted_cells

    def placed(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """The rows, the distinct wells among them by their place, their coordinates, and the well of each row."""
        rows = rows.combine_chunks()
        who, first, of = np.unique(rows["w_ord"].to_numpy(), return_index=True, return_inverse=True)
        return rows, who, np.stack([rows[k].to_numpy()[first] for k in "xy"], axis=1) / 1000.0, of

    def dense(rows: pa.Table, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Channels of the wells at the depths of the layer, as read by others and as measured."""
        lists = {k: rows[k].chunk(0) for k in ("g", *COLS, *[c for c in ("hidden",) if c in rows.column_names])}
        row = np.repeat(of, lists["g"].value_lengths().to_numpy())
        g = lists["g"].flatten().to_numpy()
        out = np.full((n, len(COLS), layer), np.nan)
        for i, c in enumerate(COLS):
            out[row, i, g] = lists[c].flatten().to_numpy(zero_copy_only=False)
        if not hide:
            return out, out
        shown, off = out.copy(), lists["hidden"].flatten().to_numpy(zero_copy_only=False).astype(bool)
        shown[row[off], :, g[off]] = np.nan
        return shown, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = mine = None

        def finished():
            rows, who, _, of = mine
            shape = (len(who), len(COLS), layer)
            with np.errstate(invalid="ignore", divide="ignore"):
                guess = num / den if kind == "idw" else np.where(np.isfinite(den), num, np.nan)
            return emit(tile, rows, of, guess.reshape(shape), truth.reshape(shape) if told else None)

        for key, rows in _tile_layers(batches, keys):
            if key[:2] != tile:
                if mine is not None:
                    yield from finished()
                tile, mine = key[:2], None
            if key[2] == 0:
                if key[0] < 0:
                    rows = rows.combine_chunks()
                    of = np.zeros(rows.num_rows, int)
                    mine = rows, np.zeros(1, int), None, of
                else:
                    mine = placed(rows)
                size = (len(mine[1]), len(COLS) * layer)
                num, den = np.zeros(size), np.zeros(size) if kind == "idw" else np.full(size, np.inf)
                truth = np.full(size if told else 0, np.nan)
            elif mine is not None:
                rows, who, xy, of = placed(rows)
                shown, seen = (v.reshape(len(who), -1) for v in dense(rows, of, len(who)))
                there = np.minimum(np.searchsorted(who, mine[1]), len(who) - 1)
                own = np.where(who[there] == mine[1], there, -1)    # a target's own row among the sources, -1: none
                if told:
                    truth[own >= 0] = seen[own[own >= 0]]
                for i in range(0, len(own), step):
                    part = slice(i, i + step)
                    more, weight = estimate(mine[2][part], xy, own[part], shown)
                    if kind == "idw":
                        num[part] += more
                        den[part] += weight
                    else:
                        nearer = weight < den[part]
                        num[part][nearer], den[part][nearer] = more[nearer], weight[nearer]
        if mine is not None:
            yield from finished()

    return sent.mapInArrow(run, schema)


def _measured(v: np.ndarray) -> pa.Array:
    return pa.array(v, type=pa.float64(), from_pandas=True)


def same_depth(targets: DataFrame, grid: DataFrame, coords: DataFrame, kind: str = "idw") -> DataFrame:
    """Spatial estimate of every target (well, g) from the other wells measured there.

    ``kind``: ``idw`` (inverse squared distance over all available wells) or ``nnwell``
    (value of the nearest available well).  Output: well, g, ``p_<log>`` (NULL when no
    other well is available).
    """
    layer = LAYER
    tgt = targets.where("well IS NOT NULL AND g IS NOT NULL").groupBy("well", F.expr(f"g div {layer}").alias("db")).agg(
        F.collect_set(F.expr(f"CAST(g - (g div {layer}) * {layer} AS SMALLINT)")).alias("g"))
    tgt = tgt.join(coords.select("well").distinct(), "well", "left_semi")
    schema = T.StructType([T.StructField("well", coords.schema["well"].dataType), T.StructField("g", T.LongType()),
                           *[T.StructField(f"p_{c}", T.DoubleType()) for c in COLS]])

    def emit(tile, rows, of, guess, truth):
        lists = rows["g"].chunk(0)
        row, g = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().astype("int64")
        for i in range(0, len(row), POINT_ROWS):
            r, at = row[i:i + POINT_ROWS], g[i:i + POINT_ROWS]
            yield pa.RecordBatch.from_arrays([rows["well"].chunk(0).take(pa.array(r)), pa.array(at + tile[1] * layer),
                                              *[_measured(guess[of[r], k, at]) for k in range(len(COLS))]], schema.names)

    return _tiled(tgt, grid, coords, kind, emit, schema)


def spatial_points(specs: DataFrame, grid: DataFrame, coords: DataFrame, offsets: DataFrame, kind: str = "idw",
                   keep: Sequence[str] = ("well", "start"), told: bool = False, hide: bool = False) -> DataFrame:
    """Points (keep, t, method, log, pred) of the masked positions; no available well gives the fold mean ``mu_<log>``.

    ``specs`` holds the masks of :func:`gapwright.operators.masking.mask_specs` with the fold means of their well.  Each well,
    depth and channel of a tile is estimated once, however many windows and scenarios mask it, and the points leave the task that
    estimates them.  ``told`` adds the measured value as ``truth``; with ``hide`` the rows of the grid marked ``hidden`` are kept
    from all estimates.
    """
    layer, keep = LAYER, list(keep)
    means = [f"mu_{c}" for c in COLS]
    cols = list(dict.fromkeys([*keep, "well", "mask_bits", *means]))
    runs = specs.join(offsets.select("well", F.col("offset").alias("_off")), "well").select(
        *cols, (F.col("start") + F.col("_off")).alias("_g"), F.explode("runs").alias("r"))
    runs = runs.select(*cols, (F.col("_g") + F.col("r.a")).alias("_lo"), (F.col("_g") + F.col("r.b") - 1).alias("_hi"), F.col("r.a").alias("_a"))
    parts = runs.withColumn("db", F.explode(F.expr(f"sequence(_lo div {layer}, _hi div {layer})")))
    parts = parts.withColumn("_from", F.expr(f"greatest(_lo, db * {layer})"))
    tgt = parts.select(*cols, "db", F.expr(f"CAST(_from - db * {layer} AS INT)").alias("lo"),
                       F.expr(f"CAST(least(_hi + 1, (db + 1) * {layer}) - _from AS INT)").alias("n"), F.expr("CAST(_a + _from - _lo AS INT)").alias("t"))
    schema = T.StructType([specs.schema[k] for k in keep] + [T.StructField("t", T.IntegerType()), T.StructField("method", T.StringType()),
                          T.StructField("log", T.StringType()), *[T.StructField(k, T.DoubleType()) for k in ("pred", "truth")[:1 + told]]])

    def emit(tile, rows, of, guess, truth):
        n = rows["n"].to_numpy()
        for part in np.split(np.arange(len(n)), np.searchsorted(np.cumsum(n), np.arange(POINT_ROWS, n.sum(), POINT_ROWS))):
            row = np.repeat(part, n[part])
            step = np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            at, t, bits = rows["lo"].to_numpy()[row] + step, rows["t"].to_numpy()[row] + step, rows["mask_bits"].to_numpy()[row]
            for i, c in enumerate(COLS):
                hit = np.flatnonzero(bits & (1 << i))
                if not len(hit):
                    continue
                r, g = row[hit], at[hit]
                pred, mu = guess[of[r], i, g], rows[f"mu_{c}"].to_numpy()[r]
                pick = pa.array(r)
                yield pa.RecordBatch.from_arrays([
                    *[rows[k].chunk(0).take(pick) for k in keep], pa.array(t[hit].astype("int32")), pa.array([kind]).take(pa.array(np.zeros(len(r), "int64"))),
                    pa.array([c.upper()]).take(pa.array(np.zeros(len(r), "int64"))), _measured(np.where(np.isnan(pred), mu, pred)),
                    *[_measured(v[of[r], i, g]) for v in ([truth] if told else [])]], schema.names)

    return _tiled(tgt, grid, coords, kind, emit, schema, told, hide)


def predict_spatial(masked: DataFrame, fits: DataFrame, grid: DataFrame, coords: DataFrame, offsets: DataFrame,
                    kind: str = "idw", ranges: DataFrame | None = None) -> DataFrame:
    """Masked window positions with ``p_<kind>_<log>``; no available well gives the fold mean.

    Each distinct (well, depth) is estimated once, however many windows and scenarios mask it.
    """
    keep = [c for c in masked.columns if not c.startswith("x_")]
    hit = masked.where("mask_bits > 0").join(offsets.select("well", "offset"), "well").withColumn(
        "g", F.col("start") + F.col("t") + F.col("offset"))
    est = kriging(hit, grid, coords, ranges) if kind == "okrige" else same_depth(hit, grid, coords, kind)
    return hit.join(est, ["well", "g"], "left").join(fits, "well").select(
        *keep, *[F.coalesce(f"p_{c}", f"mu_{c}").alias(f"p_{kind}_{c}") for c in COLS])


# --- variograms and kriging ----------------------------------------------------------------------------

def _tile_layers(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of every run of equal ``keys``, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in filter(len, batches):
        at = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
        for i, j in zip(cuts, cuts[1:]):
            key = tuple(at[i].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def _pair_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (wb, li, db, blob) from layer rows sorted by (wb, db): the wells of a block with their samples of one log, compressed."""
    option = pa.ipc.IpcWriteOptions(compression="zstd")
    for (wb, db), rows in _tile_layers(batches, ("wb", "db")):
        rows = rows.combine_chunks()
        lists = {k: rows[k].chunk(0) for k in ("g", *COLS)}
        size = lists["g"].value_lengths().to_numpy()
        row, g = np.repeat(np.arange(len(size)), size), lists["g"].flatten()
        for li, c in enumerate(COLS):
            v = lists[c].flatten()
            there = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            if not len(there):
                continue
            mine, count = np.unique(row[there], return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(count)].astype("int32"))
            table = rows.select(["at", "well", "x", "y"]).take(pa.array(mine))
            for name, values in (("g", g), ("v", v)):
                table = table.append_column(name, pa.ListArray.from_arrays(ends, values.take(pa.array(there))))
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema, options=option) as w:
                w.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([wb]), pa.array([li], pa.int32()), pa.array([db]), pa.array([out.getvalue().to_pybytes()])],
                                             ["wb", "li", "db", "blob"])


def _pair_sums(block: int, depth: int):
    """Finished pairs of each tile (log, tb, sb), whose depth layers arrive one after the other, a row with both blocks each.

    Held are the sums of one tile and the values of one layer, whatever the number of depths.
    """
    step = max(PAIR_ROWS // block, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, kind = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                key = tuple(batch.column(k)[r].as_py() for k in ("li", "tb", "sb"))
                sides = [pa.ipc.open_stream(batch.column(k)[r].as_buffer()).read_all().combine_chunks() for k in ("left", "right")]
                if key != tile:
                    if tile is not None:
                        yield from finished(tile, kind, n, ss, wells, xy)
                    tile, kind = key, sides[0].schema.field("well").type
                    n, ss = np.zeros((block, block), np.float32), np.zeros((block, block))
                    wells, xy = ([None] * block, [None] * block), np.full((2, block, 2), np.nan)
                who, value, has = [None, None], [None, None], [None, None]
                for k, rows in enumerate(sides):
                    # a well's layer may come in several rows
                    who[k], first, of = np.unique(rows["at"].to_numpy(), return_index=True, return_inverse=True)
                    xy[k, who[k]] = np.stack([rows[c].to_numpy()[first] for c in "xy"], axis=1)
                    for i, name in zip(who[k].tolist(), rows["well"].take(pa.array(first)).to_pylist()):
                        wells[k][i] = name
                    lists = {c: rows[c].chunk(0) for c in ("g", "v")}
                    dense = np.full((len(first), depth), np.nan)
                    dense[np.repeat(of, lists["g"].value_lengths().to_numpy()), lists["g"].flatten().to_numpy()] = lists["v"].flatten().to_numpy()
                    has[k] = np.isfinite(dense)
                    value[k] = np.where(has[k], dense, 0.0)
                    has[k] = has[k].astype(float)
                for top in range(0, len(who[0]), step):
                    cells = np.ix_(who[0][top:top + step], who[1])
                    v0, h0 = value[0][top:top + step], has[0][top:top + step]
                    n[cells] += h0 @ has[1].T
                    ss[cells] += (v0 ** 2) @ has[1].T + h0 @ (value[1] ** 2).T - 2 * v0 @ value[1].T
        if tile is not None:
            yield from finished(tile, kind, n, ss, wells, xy)

    def finished(tile, kind, n, ss, wells, xy) -> Iterator[pa.RecordBatch]:
        log, tb, sb = tile
        names = [pa.array(w, kind) for w in wells]
        for top in range(0, block, step):
            some = n[top:top + step] > 0
            if tb == sb:
                some &= np.arange(top, top + len(some))[:, None] < np.arange(block)
            i, j = np.nonzero(some)
            if not len(i):
                continue
            i += top
            count = n[i, j].astype(float)
            d = np.hypot(*(xy[0, i] - xy[1, j]).T) / 1000.0
            yield pa.RecordBatch.from_arrays(
                [names[0].take(pa.array(i)), names[1].take(pa.array(j)), pa.array([COLS[log].upper()]).take(pa.array(np.zeros(len(i), np.int64))),
                 pa.array(d), pa.array(count.astype(np.int64)), pa.array(ss[i, j] / count / 2.0)], ["a", "b", "log", "d_km", "n", "gamma"])
    return run


def pair_semivariances(grid: DataFrame, coords: DataFrame, block: int | None = None, depth: int = DEPTH_BLOCK) -> DataFrame:
    """(a, b, log, d_km, n, gamma) for every pair of wells sharing a measured depth, a < b.

    A block of wells is one partition of a checkpoint, its samples of a log and depth layer one compressed row.  A tile is a pair
    of such partitions, read where they lie: its layers follow each other in one task, which adds up three matrix products a
    layer and gives the finished pairs, so no sample is copied and no pair shuffled, however many blocks there are.  There are
    ``PAIR_BLOCKS`` blocks until a block holds ``PAIR_BLOCK`` wells.
    """
    one = coords.groupBy("well").agg(F.min(F.struct("x", "y")).alias("p")).select("well", "p.x", "p.y")
    wells = one.count()
    block = block or min(max(-(-wells // PAIR_BLOCKS), WELL_BLOCK), PAIR_BLOCK)
    nb = ordinal(one.withColumn("_slab", _order_slab(one)), [], "_slab", ["well"], "w_ord").select("well", "x", "y", "w_ord")
    layers = _depth_layers(grid.join(nb, "well"), depth).select(
        F.expr(f"w_ord div {block}").alias("wb"), "db", F.expr(f"CAST(w_ord % {block} AS INT)").alias("at"), "well", "x", "y", "g", *COLS)
    placed = layers.repartitionById(max(-(-wells // block), 1), F.col("wb").cast("int")).sortWithinPartitions("wb", "db")
    blobs = cut_lineage(placed.mapInArrow(_pair_blobs, "wb bigint, li int, db bigint, blob binary").sortWithinPartitions("li", "db"))
    released(coords.sparkSession)
    one, two = blobs.toDF("tb", "li", "db", "left"), _fresh(blobs).toDF("sb", "li2", "db2", "right")
    tiles = one.join(two.hint("shuffle_replicate_nl"), (F.col("li") == F.col("li2")) & (F.col("db") == F.col("db2")) & (F.col("tb") <= F.col("sb")))
    kind_t = dict(coords.dtypes)["well"]
    return tiles.select("li", "tb", "sb", "left", "right").mapInArrow(
        _pair_sums(block, depth), f"a {kind_t}, b {kind_t}, log string, d_km double, n bigint, gamma double")


def variogram_fits(pairs: DataFrame, scale: DataFrame, size: int = VARIOGRAM_GRID) -> DataFrame:
    """(well, log, range_km, sill): exponential model fitted on the pairs without the held-out well.

    Unweighted least squares over a geometric grid of ranges; for each range the sill has a
    closed form, so a fold needs only sums over pairs: all pairs minus the pairs of its own
    well.  The grid follows the fold's smallest and largest distance, which differ from the
    global ones only for the (at most four) wells of the extreme pairs.
    """
    ext = pairs.groupBy("log").agg(
        F.min("d_km").alias("h_lo"), F.max("d_km").alias("h_hi"),
        F.min_by(F.struct("a", "b"), "d_km").alias("p_lo"), F.max_by(F.struct("a", "b"), "d_km").alias("p_hi"))
    special = ext.select("log", F.explode(F.array_distinct(F.array("p_lo.a", "p_lo.b", "p_hi.a", "p_hi.b"))).alias("well"))
    own_ext = (pairs.join(special, "log").where((F.col("a") != F.col("well")) & (F.col("b") != F.col("well")))
               .groupBy("log", "well").agg(F.min("d_km").alias("s_lo"), F.max("d_km").alias("s_hi")))
    ends = pairs.select("log", "d_km", "gamma", F.explode(F.array("a", "b")).alias("well"))
    folds = (ends.select("log", "well").distinct().join(ext.select("log", "h_lo", "h_hi"), "log")
             .join(own_ext, ["log", "well"], "left")
             .select("log", "well", F.coalesce("s_lo", "h_lo").alias("lo"), F.coalesce("s_hi", "h_hi").alias("hi")))
    kind_t = dict(pairs.dtypes)["a"]

    def sums(h, gam, lo, hi):
        r = np.geomspace(max(lo, 0.5), hi * 3, size)
        f = 1 - np.exp(-h[:, None] / r)
        return r, (f * f).sum(0), f.T @ gam

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["gamma"].to_numpy()
        r, ff, fg = sums(pdf["d_km"].to_numpy(), g, pdf["lo"].iat[0], pdf["hi"].iat[0])
        return pd.DataFrame({"log": pdf["log"].iat[0], "well": pdf["well"].iat[0], "lo": pdf["lo"].iat[0], "hi": pdf["hi"].iat[0],
                             "k": np.arange(size), "r": r, "ff": ff, "fg": fg, "gg": g @ g, "m": float(len(g))})

    def totals(frames):
        for pdf in frames:
            for (log, lo, hi), p in pdf.groupby(["log", "lo", "hi"]):
                g = p["gamma"].to_numpy()
                _, ff, fg = sums(p["d_km"].to_numpy(), g, lo, hi)
                yield pd.DataFrame({"log": log, "lo": lo, "hi": hi, "k": np.arange(size), "t_ff": ff, "t_fg": fg,
                                    "t_gg": g @ g, "t_m": float(len(g))})

    mine = ends.join(folds, ["log", "well"]).groupBy("log", "well").applyInPandas(
        own, f"log string, well {kind_t}, lo double, hi double, k int, r double, ff double, fg double, gg double, m double")
    all_ = (pairs.join(folds.select("log", "lo", "hi").distinct(), "log").mapInPandas(
        totals, "log string, lo double, hi double, k int, t_ff double, t_fg double, t_gg double, t_m double")
        .groupBy("log", "lo", "hi", "k").agg(*[F.sum(c).alias(c) for c in ("t_ff", "t_fg", "t_gg", "t_m")]))
    j = mine.join(all_, ["log", "lo", "hi", "k"])
    ff, fg, gg = (F.col(f"t_{c}") - F.col(c) for c in ("ff", "fg", "gg"))
    sill = fg / F.greatest(ff, F.lit(1e-12))
    err = gg - 2 * sill * fg + sill * sill * ff
    best = j.withColumn("sill", sill).withColumn("err", err).groupBy("log", "well").agg(
        F.min_by(F.struct("r", "sill"), F.struct("err", "k")).alias("b"), F.first(F.col("t_m") - F.col("m")).alias("n_pairs"))
    few = F.col("n_pairs") < 3
    return _with_scalar(best, scale).select(
        "well", "log", F.when(few, F.col("scale_km")).otherwise(F.col("b.r")).alias("range_km"),
        F.when(few, F.lit(1.0)).otherwise(F.greatest("b.sill", F.lit(1e-6))).alias("sill"), "n_pairs")


def _gamma(d, r):
    return 1.0 - np.exp(-d / r)


def _weighted(near: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Inverse-square-distance means, one row of ``near`` per target."""
    pull = np.maximum(near, IDW_MIN_KM) ** -2.0
    return pull @ values / pull.sum(axis=1)


def _kriged(sources: np.ndarray, near: np.ndarray, values: np.ndarray, reach: float) -> np.ndarray:
    """Ordinary kriging of all targets (rows of ``near``) in one solve; a target without a finite solution takes the
    inverse-distance mean."""
    plain = _weighted(near, values)
    if len(values) < 3 or not np.isfinite(reach):
        return plain
    border = np.pad(_gamma(sources, reach), ((0, 1), (0, 1)), constant_values=1.0)
    border[-1, -1] = 0.0
    right = np.vstack([_gamma(near, reach).T, np.ones(len(near))])
    try:
        weights = np.linalg.solve(border, right)[:-1]
    except np.linalg.LinAlgError:
        return plain
    got = values @ weights
    return np.where(np.isfinite(weights).all(axis=0), got, plain)


def _krige_left_out(dist, v, r):
    """Kriging of every point from all the others, from one inverse (deletion residuals)."""
    n = len(v)
    if n < 4:
        return None
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = _gamma(dist, r)
    system[n, n] = 0.0
    try:
        inv = np.linalg.inv(system)
    except np.linalg.LinAlgError:
        return None
    diag = np.diag(inv)[:n]
    out = v - (inv[:n, :n] @ v) / np.where(diag == 0, np.nan, diag)
    return out if np.all(np.isfinite(out)) else None


def kriging(targets: DataFrame, grid: DataFrame, coords: DataFrame, ranges: DataFrame, max_wells: int = 20_000) -> DataFrame:
    """Ordinary kriging of every target (well, g) from the other wells at the same depth.

    ``ranges`` holds (well, log, range_km).  A kriging system couples all wells measured at a
    depth, so one depth is one task by definition; a depth with more than ``max_wells`` wells
    is refused with an error rather than thinned, so this is no operator for tables of any size.  All targets of a depth that share a range
    come from a single inverse.
    """
    wide = ranges.groupBy("well").pivot("log", [c.upper() for c in COLS]).agg(F.first("range_km"))
    wide = wide.select("well", *[F.col(c.upper()).alias(f"r_{c}") for c in COLS])
    tgt = targets.select("well", "g").distinct().join(coords, "well").join(wide, "well", "left")
    src = grid.select("well", "g", *COLS).join(coords, "well").join(tgt.select("g").distinct(), "g", "left_semi")
    kind_t = dict(coords.dtypes)["well"]

    def solve(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"well": t["well"], "g": t["g"], **{f"p_{c}": np.full(len(t), np.nan) for c in COLS}})
        if len(s) > max_wells:
            raise ValueError(f"{len(s)} wells at depth {s['g'].iat[0]}: kriging is limited to {max_wells}")
        for c in COLS:
            have = s[s[c].notna()]
            if not len(have):
                continue
            v, xy = have[c].to_numpy(dtype=float), have[["x", "y"]].to_numpy() / 1000.0
            dist = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
            where = {w: i for i, w in enumerate(have["well"])}
            cache: dict[float, np.ndarray | None] = {}
            pred = np.full(len(t), np.nan)
            for j, (w, x, y, r) in enumerate(zip(t["well"], t["x"], t["y"], t[f"r_{c}"])):
                i = where.get(w)
                others = np.arange(len(v)) != i if i is not None else np.ones(len(v), bool)
                if not others.any():
                    continue
                if i is not None and np.isfinite(r):
                    if r not in cache:
                        cache[r] = _krige_left_out(dist, v, r)
                    if cache[r] is not None:
                        pred[j] = cache[r][i]
                        continue
                d = np.hypot(xy[others, 0] - x / 1000.0, xy[others, 1] - y / 1000.0)
                pred[j] = _kriged(dist[np.ix_(others, others)], d[None, :], v[others], r)[0]
            out[f"p_{c}"] = pred
        return out

    got = tgt.groupBy("g").cogroup(_fresh(src).groupBy("g")).applyInPandas(
        solve, f"well {kind_t}, g bigint, " + ", ".join(f"p_{c} double" for c in COLS))
    return got.select("well", "g", *[F.nanvl(f"p_{c}", F.lit(None).cast("double")).alias(f"p_{c}") for c in COLS])


# --- neighbour availability --------------------------------------------------------------------------------

def neighbour_availability(windows: DataFrame, edges: DataFrame, weights: DataFrame, grid: DataFrame,
                           offsets: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per held-out well: graph neighbours measured at its window depths, their distance and weight.

    Averages over the windows of the well, each window over its depths and logs.  What a well
    measured is kept as words of 64 depths, one bit each, so a window meets a neighbour in
    ``size / 64 + 1`` narrow rows, and depths are counted without ever becoming rows.
    """
    first = F.col("start") + F.col("offset")
    word = F.explode(F.sequence(F.shiftright(first, 6), F.shiftright(first + (size - 1), 6)))
    lo, hi = "CAST(greatest(first - word * 64, 0) AS INT)", f"CAST(first + {size} - word * 64 AS INT)"
    span = F.expr(f"(CASE WHEN {hi} >= 64 THEN -1L ELSE shiftleft(1L, {hi}) - 1L END) & ~(shiftleft(1L, {lo}) - 1L)")
    pos = (windows.join(offsets.select("well", "offset"), "well")
           .select("well", "start", first.alias("first"), word.alias("word"))
           .select("well", "start", "word", span.alias("span")))
    nb = edges.join(weights.select("src", "dst", "weight"), ["src", "dst"]).select(F.col("src").alias("well"), "dst", "d_km", "weight")
    bit = F.expr("shiftleft(1L, CAST(g & 63 AS INT))")
    per = grid.groupBy(F.col("well").alias("dst"), F.shiftright("g", 6).cast("bigint").alias("word")).agg(*[
        F.coalesce(F.bit_or(F.when(F.col(c).isNotNull(), bit)), F.lit(0).cast("bigint")).alias(c) for c in COLS])
    hit = (pos.join(nb, "well").join(per, ["dst", "word"])
           .select("well", "start", "word", "d_km", "weight", *[F.col(c).bitwiseAND(F.col("span")).alias(c) for c in COLS]))
    count = lambda r, c: F.bit_count(r[c]).cast("bigint")
    fresh = lambda acc, r, c: F.bit_count(r[c].bitwiseAND(F.bitwise_not(acc[c]))).cast("bigint")
    none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in COLS], F.lit(0).cast("bigint").alias("cells"), F.lit(0.0).alias("dist"))

    def nearest(acc, r):
        new = sum((fresh(acc, r, c) for c in COLS[1:]), fresh(acc, r, COLS[0]))
        return F.struct(*[acc[c].bitwiseOR(r[c]).alias(c) for c in COLS], (acc["cells"] + new).alias("cells"),
                        (acc["dist"] + new * r["d_km"]).alias("dist"))

    row = F.struct("d_km", "weight", *COLS)
    measured = sum((count(F.col("r"), c) for c in COLS[1:]), count(F.col("r"), COLS[0]))
    words = hit.withColumn("r", row).groupBy("well", "start", "word").agg(
        F.sum(measured).alias("na"), F.sum(F.col("weight") * measured).alias("wa"),
        F.aggregate(F.array_sort(F.collect_list("r")), none, nearest).alias("near"))
    per_window = words.groupBy("well", "start").agg(
        (F.sum("na") / (size * len(COLS))).alias("na"), F.try_divide(F.sum("near.dist"), F.sum("near.cells")).alias("dn"),
        (F.sum("wa") / (size * len(COLS))).alias("wa"))
    full = windows.select("well", "start").join(per_window, ["well", "start"], "left")
    k = edges.groupBy(F.col("src").alias("well")).agg(F.count(F.lit(1)).alias("k_neighbours"))
    return full.groupBy("well").agg(
        F.avg(F.coalesce("na", F.lit(0.0))).alias("n_avail"), F.avg("dn").alias("d_nearest_km"),
        F.avg(F.coalesce("wa", F.lit(0.0))).alias("w_avail")).join(k, "well")


def neighbour_gain(errors: DataFrame, model: str, control: str) -> DataFrame:
    """Error of the control minus error of the model per (scenario, well); positive = neighbours help."""
    a = errors.where(F.col("method") == control).select("scenario", "well", F.col("nrmse").alias("ec"))
    b = errors.where(F.col("method") == model).select("scenario", "well", F.col("nrmse").alias("em"))
    return a.join(b, ["scenario", "well"]).select("scenario", "well", (F.col("ec") - F.col("em")).alias("gain"))
