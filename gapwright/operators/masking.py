"""Artificial missingness.

Two sources of randomness give the same operator:

* ``hash`` -- every draw is arithmetic on (well, start, salt); nothing is shuffled and any
  SQL engine reproduces it;
* ``pcg64`` -- bit-exact NumPy generator streams.  The stream of a (scenario, mask seed)
  restarts for each well, so the k-th window of *any* well gets the k-th draw: one spec
  table indexed by the window ordinal serves all wells through an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (BLACKOUT_FRACTION, BLOCK_LENGTHS, COOCCUR_DEFAULT, LOGS, N_POINTS, SCENARIOS,
                         WINDOW, eval_seed)
from ..functions.draws import uniform_sql, well_key, with_draws
from ..functions.ordered import ordinal
from .cleaning import COLS

#: salt base of each scenario; a mask seed shifts all of them by 1000
SALT = {"single": 100, "block": 200, "profile": 300, "blackout": 400, "blackout_emp": 500}
SALT_TRAIN = 900
#: training masks use mask seeds from here up, away from the evaluation masks
TRAIN_SEED_BASE = 500
SALT_SPLIT = 950
ORDER_BUCKETS = 1024
SPEC_SCHEMA = ("scenario string, mask_seed int, win_ord bigint, mask_cols int, mask_from int, "
               "mask_to int, mask_points array<int>")


def _check(scenario: str) -> None:
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}; known: {', '.join(SCENARIOS)}")


def normalised(cooccur: Mapping[int, float] | None) -> list[tuple[int, float]]:
    """Sorted (K, probability) pairs summing to one."""
    table = sorted((cooccur or COOCCUR_DEFAULT).items())
    total = sum(p for _, p in table)
    return [(k, p / total) for k, p in table]


def dataset_cooccur(cooccur_df: DataFrame) -> dict[int, float]:
    """Measured K-distribution as a plain dict: one row for each K from 1 to the number of channels."""
    return {r["k"]: r["prob"] for r in cooccur_df.where(F.col("k").between(1, len(LOGS))).collect()}


def _placement(scenarios: Iterable[str], size: int, lengths: Sequence[int], fraction: tuple[float, float],
               cooccur: Mapping[int, float] | None, allow_full: bool) -> tuple[str, str, str]:
    """SQL over the draws ``_u0 ..``: masked channels, length and relative place of a mask, by scenario."""
    c = len(LOGS)
    full = (1 << c) - 1
    use = set(scenarios)
    one = f"shiftleft(1, CAST(floor(_u0 * {c}) AS INT))"
    cols, length, place = {s: one for s in use}, {}, {}
    if "profile" in use:
        length["profile"], place["profile"] = str(size), "0.0D"
    if "block" in use:
        picks = " ".join(f"WHEN {i} THEN {min(v, size)}" for i, v in enumerate(lengths))
        length["block"] = f"CASE CAST(floor(_u1 * {len(lengths)}) AS INT) {picks} ELSE {min(lengths[-1], size)} END"
        place["block"] = "_u2"
    if "blackout" in use:
        cum, ladder = 0.0, []
        for k, p in normalised(cooccur):
            cum += p
            ladder.append((min(k, c if allow_full else c - 1), cum))
        k_sql = "CASE " + " ".join(f"WHEN _u0 < {p!r}D THEN {k}" for k, p in ladder[:-1]) + f" ELSE {ladder[-1][0]} END"
        bit = f"shiftleft(1, CAST(floor(_u1 * {c}) AS INT))"
        cols["blackout"] = f"CASE {k_sql} WHEN 1 THEN {bit} WHEN {c - 1} THEN {full} - {bit} ELSE {full} END"
        lo, hi = fraction
        length["blackout"] = f"greatest(1, least({size}, CAST(bround(({lo}D + {hi - lo}D * _u2) * {size}) AS INT)))"
        place["blackout"] = "_u3"

    def by_scenario(table: Mapping[str, str], default: str) -> str:
        if not table:
            return default
        return "CASE scenario " + " ".join(f"WHEN '{s}' THEN {e}" for s, e in table.items()) + f" ELSE {default} END"

    return by_scenario(cols, "0"), by_scenario(length, "0"), by_scenario(place, "0.0D")


def _drawn(df: DataFrame, scenarios: Sequence[str], n_points: int) -> DataFrame:
    """Add the draws ``_u0 ..`` of each row's (well, start, scenario, mask seed)."""
    base = "CASE scenario " + " ".join(f"WHEN '{s}' THEN {SALT[s]}" for s in scenarios) + " END"
    df = df.withColumn("_wkey", well_key(df)).withColumn("_salt", F.expr(f"mask_seed * 1000L + {base}"))
    n_draws = max({"profile": 1, "block": 3, "blackout": 4, "single": n_points + 1}[s] for s in scenarios)
    return with_draws(df, "_wkey", "start", "_salt", {f"_u{k}": k for k in range(n_draws)})


def mask_specs(windows: DataFrame, scenarios: Iterable[str] = SCENARIOS, mask_seeds: Iterable[int] = (0,), size: int = WINDOW,
               n_points: int = N_POINTS, lengths: Sequence[int] = BLOCK_LENGTHS, fraction: tuple[float, float] = BLACKOUT_FRACTION,
               cooccur: Mapping[int, float] | None = None, allow_full: bool = True) -> DataFrame:
    """One row per (window, scenario, mask seed): the masked channels ``mask_bits`` and the maximal masked ``runs``.

    A run is a struct (a, b, before, after): positions a to b - 1 are masked, and the knots beyond the two next to the run lie
    at ``before`` < a - 1 and ``after`` > b (-1 or ``size`` and more where the window ends).  The masks are those of
    :func:`mask_bits`; no sample is touched.
    """
    scenarios = list(scenarios)
    for s in scenarios:
        _check(s)
    keep = windows.columns
    cells = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(int(m)).alias("mask_seed")) for s in scenarios for m in mask_seeds])
    df = _drawn(windows.select(*keep, F.inline(cells)), scenarios, n_points)
    bits, length, place = _placement(scenarios, size, lengths, fraction, cooccur, allow_full)
    points = ("array_sort(array_distinct(array(" + ", ".join(f"CAST(floor(_u{k} * {size}) AS INT)" for k in range(1, n_points + 1)) + ")))"
              if "single" in scenarios else "CAST(array() AS array<int>)")
    df = df.select(*keep, "scenario", "mask_seed", F.expr(bits).cast("int").alias("mask_bits"), F.expr(length).alias("_len"), F.expr(place).alias("_place"),
                   F.expr(f"CASE WHEN scenario = 'single' THEN {points} END").alias("_p"))
    # each level is emitted by a one-element generator, so that it is a finished column for the next one and not a copy of its text
    settled = lambda d, *cols: d.select(*[c for c in d.columns if c not in cols], F.inline(F.array(F.struct(*cols))))
    df = settled(df, "mask_bits", "_len", "_place", "_p")
    df = df.withColumn("_from", F.expr(f"CAST(floor(_place * ({size} - _len + 1)) AS INT)"))
    ends = "filter(_p, x -> NOT array_contains(_p, x + {}))"
    df = df.withColumn("_a", F.expr(f"CASE WHEN scenario = 'single' THEN {ends.format(-1)} ELSE array(_from) END"))
    df = df.withColumn("_b", F.expr(f"CASE WHEN scenario = 'single' THEN transform({ends.format(1)}, x -> x + 1) ELSE array(CAST(_from + _len AS INT)) END"))
    df = settled(df, "_a", "_b")
    runs = ("transform(_a, (a, i) -> named_struct('a', a, 'b', _b[i], "
            "'before', CASE WHEN i > 0 AND _b[i - 1] = a - 1 THEN _a[i - 1] - 1 ELSE a - 2 END, "
            "'after', CASE WHEN i + 1 < size(_a) AND _a[i + 1] = _b[i] + 1 THEN _b[i + 1] ELSE _b[i] + 1 END))")
    return df.select(*keep, "scenario", "mask_seed", "mask_bits", F.explode(F.array(F.expr(runs))).alias("runs"))


def mask_bits(df: DataFrame, scenarios: Sequence[str], size: int = WINDOW, n_points: int = N_POINTS,
              lengths: Sequence[int] = BLOCK_LENGTHS, fraction: tuple[float, float] = BLACKOUT_FRACTION,
              cooccur: Mapping[int, float] | None = None, allow_full: bool = True) -> DataFrame:
    """Add ``mask_bits``: the channels masked at depth position ``t`` of each window row.

    ``df`` carries well, start, t, scenario and ``mask_seed``.  Everything is row-local
    arithmetic, so the incoming partitioning is kept.
    """
    for s in scenarios:
        _check(s)
    keep = df.columns
    df = _drawn(df, scenarios, n_points)
    cols_sql, len_sql, place_sql = _placement(scenarios, size, lengths, fraction, cooccur, allow_full)
    hits = (" OR ".join(f"t = CAST(floor(_u{k} * {size}) AS INT)" for k in range(1, n_points + 1))
            if "single" in scenarios else "false")
    df = df.select(*keep, F.expr(cols_sql).alias("_cols"),
                   F.expr(len_sql).alias("_len"), F.expr(place_sql).alias("_place"),
                   F.expr(f"scenario = 'single' AND ({hits})").alias("_hit"))
    df = df.withColumn("_from", F.expr(f"CAST(floor(_place * ({size} - _len + 1)) AS INT)"))
    inside = (F.col("t") >= F.col("_from")) & (F.col("t") < F.col("_from") + F.col("_len"))
    bits = F.when(F.col("_hit") | inside, F.col("_cols")).otherwise(0).cast("int")
    # emitted by a one-element generator: a later filter on mask_bits then reads the finished
    # column instead of being pushed down as a copy of the whole draw arithmetic
    return df.select(*keep, F.explode(F.array(bits)).alias("mask_bits"))


def apply_masks(ws: DataFrame, scenarios: Iterable[str] = SCENARIOS, mask_seeds: Iterable[int] = (0,),
                size: int = WINDOW, **kw) -> DataFrame:
    """Cross every window sample with (scenario, mask_seed) and mark the masked channels.

    Adds ``scenario``, ``mask_seed``, ``mask_bits`` and the model inputs ``x_<log>`` (NULL
    where masked).  No shuffle: the (well, start) partitioning is kept.
    """
    scenarios = list(scenarios)
    cells = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(int(m)).alias("mask_seed"))
                      for s in scenarios for m in mask_seeds])
    exploded = ws.select(*ws.columns, F.inline(cells))
    return with_inputs(mask_bits(exploded, scenarios, size, **kw))


def with_inputs(df: DataFrame) -> DataFrame:
    """Add ``x_<log>``: the channel with its masked positions removed."""
    return df.select("*", *[
        F.when(F.col("mask_bits").bitwiseAND(1 << i) == 0, F.col(c)).alias(f"x_{c}") for i, c in enumerate(COLS)])


def mask_summary(masked: DataFrame) -> DataFrame:
    """Per window: masked samples of each channel and the masked depth range."""
    hit = lambda i: (F.col("mask_bits").bitwiseAND(1 << i) > 0).cast("int")
    return (masked.where("mask_bits > 0").groupBy("scenario", "mask_seed", "well", "start").agg(
        *[F.sum(hit(i)).alias(f"n_{c}") for i, c in enumerate(COLS)],
        F.min("t").alias("t_min"), F.max("t").alias("t_max")))


# --- random orders over windows ----------------------------------------------------------

def shuffled(windows: DataFrame, seed: int, salt: int, name: str = "pos", buckets: int = ORDER_BUCKETS) -> DataFrame:
    """Position of every window in a seeded random order, and the number of windows ``n_all``.

    Windows are bucketed by their draw, so numbering runs in ``buckets`` balanced tasks.
    """
    df = windows.withColumn("wkey", well_key(windows))
    df = df.withColumn("_u", F.expr(uniform_sql("wkey", "start", f"{int(seed) * 1000 + salt}L")))
    df = df.withColumn("_slab", F.floor(F.col("_u") * buckets))
    out = ordinal(df, [], "_slab", ["_u", "well", "start"], name)
    total = windows.agg(F.count(F.lit(1)).alias("n_all"))
    return _with_scalar(out, total).drop("_u", "_slab", "wkey")


def _with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (the broadcast side is one row by construction)."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def training_plan(windows: DataFrame, seed: int = 0, held_out: Column | None = None) -> DataFrame:
    """Assign a quarter of the training windows to each scenario.

    The four parts follow an even split: the first ``n % 4`` parts get one window more.
    ``held_out`` removes the windows of a held-out well before the order is drawn.
    """
    train = windows if held_out is None else windows.where(~held_out)
    pos = shuffled(train, seed, SALT_TRAIN)
    k = len(SCENARIOS)
    q, r = F.expr(f"n_all div {k}"), F.col("n_all") % k
    edge = r * (q + 1)
    part = F.when(F.col("pos") < edge, F.floor(F.col("pos") / (q + 1))).otherwise(
        r + F.floor((F.col("pos") - edge) / F.greatest(q, F.lit(1))))
    return pos.withColumn("part", part.cast("int")).withColumn(
        "scenario", F.element_at(F.array(*[F.lit(s) for s in SCENARIOS]), F.col("part") + 1)).drop("n_all", "pos")


def training_masks(ws: DataFrame, windows: DataFrame, seed: int = 0, held_out: Column | None = None,
                   size: int = WINDOW, **kw) -> DataFrame:
    """Mixed training corruption: every window masked under its assigned scenario."""
    plan = training_plan(windows, seed, held_out).select("well", "start", "scenario")
    joined = ws.join(plan, ["well", "start"])
    joined = joined.withColumn("mask_seed", F.lit(TRAIN_SEED_BASE + int(seed)))
    return with_inputs(mask_bits(joined, list(SCENARIOS), size, **kw))


def window_split(windows: DataFrame, seed: int = 0, test_frac: float = 0.2) -> DataFrame:
    """Random window-level split: ``is_test`` marks round(frac * n) windows."""
    pos = shuffled(windows, seed, SALT_SPLIT)
    n_test = F.bround(F.col("n_all") * test_frac)
    return pos.withColumn("is_test", F.col("pos") < n_test).drop("n_all", "pos")


def subsample(windows: DataFrame, n: int | Column, seed: int) -> DataFrame:
    """A seeded subset of exactly min(n, count) windows, without replacement."""
    limit = F.lit(n) if isinstance(n, int) else n
    return shuffled(windows, seed, SALT_SPLIT + 1).where(F.col("pos") < limit).drop("n_all", "pos")


# --- empirical blackout ---------------------------------------------------------------------

def interval_catalogue(iv: DataFrame, buckets: int = ORDER_BUCKETS) -> DataFrame:
    """Observed (absent set, length) pairs under a dense ordinal, for indexed draws."""
    df = iv.select("well", "start", "code", "length").withColumn("wkey", well_key(iv))
    df = df.withColumn("_slab", F.floor(F.expr(uniform_sql("wkey", "start", "77L")) * buckets))
    return ordinal(df, [], "_slab", ["_slab", "well", "start"], "iv_ord").select("iv_ord", "code", "length")


def empirical_masks(segments: DataFrame, catalogue: DataFrame, reps: int = 5, mask_seed: int = 0) -> DataFrame:
    """One observed interval drawn per (segment, replicate) and placed inside the segment.

    An interval at least as long as the segment masks it whole.  Output: well, seg_start,
    seg_end, rep, mask_seed, mask_cols and the absolute sample range [mask_from, mask_to).
    """
    total = catalogue.agg(F.count(F.lit(1)).alias("n_iv"))
    base = SALT["blackout_emp"]
    seg = segments.select("well", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"),
                          well_key(segments).alias("wkey"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    seg = _with_scalar(seg, total)
    draw = lambda k: uniform_sql("wkey", "seg_start", f"{int(mask_seed) * 1000 + base + k}L + 2 * rep")
    seg = seg.withColumn("iv_ord", F.expr(f"CAST(floor({draw(0)} * n_iv) AS BIGINT)")).withColumn("_place", F.expr(draw(1)))
    hit = seg.join(catalogue, "iv_ord")
    n = F.col("seg_end") - F.col("seg_start")
    whole = F.col("length") >= n
    offset = F.floor(F.col("_place") * (n - F.col("length") + 1))
    return hit.select(
        "well", "seg_start", "seg_end", "rep", F.lit(int(mask_seed)).alias("mask_seed"),
        F.col("code").alias("mask_cols"),
        F.when(whole, F.col("seg_start")).otherwise(F.col("seg_start") + offset).alias("mask_from"),
        F.when(whole, F.col("seg_end")).otherwise(F.col("seg_start") + offset + F.col("length")).alias("mask_to"))
