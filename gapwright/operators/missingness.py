"""Interval and gap analytics of the natural missingness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LOGS, STEP_M, WINDOW
from ..functions.ordered import CHUNK, chunk_runs, stitch

BITS = {log: 1 << i for i, log in enumerate(LOGS)}
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def absent_code(samples: DataFrame) -> DataFrame:
    """Add ``code``: the set of absent channels as a bitmask."""
    code = F.lit(0)
    for log, bit in BITS.items():
        code = code + F.when(F.col(log.lower()).isNull(), bit).otherwise(0)
    return samples.withColumn("code", code)


def combo_name(code: str = "code"):
    """``A+B`` text of a bitmask, channels in canonical order."""
    return F.concat_ws("+", *[F.when(F.col(code).bitwiseAND(bit) > 0, F.lit(log)) for log, bit in BITS.items()])


def code_runs(samples: DataFrame) -> DataFrame:
    """Runs of a constant absent set inside each chunk; the base of everything below.

    One sort of the samples; every later step works on compressed runs.
    """
    return chunk_runs(absent_code(samples).select("well", "chunk", "idx", "code"), ["well"], "idx", "code")


def intervals(runs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Maximal intervals with a constant non-empty absent set."""
    return (
        stitch(runs.where("code <> 0"), ["well", "code"], size)
        .select("well", "code", combo_name().alias("combo"), "start", "end",
                (F.col("end") - F.col("start")).alias("length"))
    )


def well_lengths(samples: DataFrame) -> DataFrame:
    """Samples per well."""
    return samples.groupBy("well").agg((F.max("idx") + 1).alias("well_len"))


def gaps(runs: DataFrame, lengths: DataFrame, size: int = CHUNK, step: float = STEP_M) -> DataFrame:
    """Per-channel gaps with bounds, metres and the edge/interior flag."""
    per_log = runs.where("code <> 0").select(
        "well", "chunk", "start", "end",
        F.explode(F.filter(F.array(*[F.when(F.col("code").bitwiseAND(bit) > 0, F.lit(log))
                                     for log, bit in BITS.items()]), lambda v: v.isNotNull())).alias("log"))
    merged = stitch(per_log, ["well", "log"], size, merge_inside=True)
    return merged.join(lengths, "well").select(
        "well", "log", "start", "end", (F.col("end") - F.col("start")).alias("length"),
        ((F.col("end") - F.col("start")) * step).alias("length_m"),
        ((F.col("start") == 0) | (F.col("end") == F.col("well_len"))).alias("is_edge"))


def intact_segments(runs: DataFrame, min_len: int = WINDOW, size: int = CHUNK) -> DataFrame:
    """Runs with every channel measured and at least ``min_len`` samples."""
    return (stitch(runs.where("code = 0"), ["well"], size)
            .where(F.col("end") - F.col("start") >= min_len)
            .select("well", "start", "end", (F.col("end") - F.col("start")).alias("length")))


def cooccur_samples(samples: DataFrame) -> DataFrame:
    """Depth samples by number of absent channels K, with percentage and probability."""
    k = (absent_code(samples).where("code > 0")
         .groupBy(F.bit_count("code").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")))
    return _shares(k)


def cooccur_intervals(iv: DataFrame) -> DataFrame:
    """Intervals by number of absent channels K."""
    return _shares(iv.groupBy(F.bit_count("code").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")))


def _shares(counts: DataFrame) -> DataFrame:
    grid = counts.sparkSession.range(1, len(LOGS) + 1).select(F.col("id").cast("int").alias("k"))
    full = grid.join(counts, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).alias("_g"))
    total = full.groupBy("_g").agg(F.sum("n").alias("_t"))
    return full.join(total, "_g").select(
        "k", "n",
        F.when(F.col("_t") > 0, F.round(F.col("n") / F.col("_t") * 100, 1)).otherwise(0.0).alias("pct"),
        (F.col("n") / F.greatest("_t", F.lit(1))).alias("prob"))


def combinations(iv: DataFrame, step: float = STEP_M) -> DataFrame:
    """Per combination: shares over samples and intervals, quartiles of the length in metres.

    Intervals are collapsed to (combination, length, count) first, so the percentile sees
    one entry per distinct length.
    """
    hist = iv.groupBy("combo", "length").agg(F.count(F.lit(1)).alias("c"))
    per = hist.groupBy("combo").agg(
        F.sum(F.col("length") * F.col("c")).alias("n_samples"), F.sum("c").alias("n_intervals"),
        _quartiles(step).alias("q"))
    per = per.withColumn("_g", F.lit(0))
    tot = per.groupBy("_g").agg(F.sum("n_samples").alias("_ts"), F.sum("n_intervals").alias("_ti"))
    return per.join(tot, "_g").select(
        "combo", "n_samples", "n_intervals",
        F.round(F.col("n_samples") / F.col("_ts") * 100, 1).alias("share_samples_pct"),
        F.round(F.col("n_intervals") / F.col("_ti") * 100, 1).alias("share_intervals_pct"),
        *[F.round(F.col("q")[i], 1).alias(f"{name}_m") for i, name in enumerate(QUARTILES)])


def _quartiles(step: float):
    probs = ", ".join(str(p) for p in QUARTILES.values())
    return F.expr(f"percentile(CAST(length AS DOUBLE) * {step}D, array({probs}), c)")


def gap_quartiles(gap_rows: DataFrame, step: float = STEP_M) -> DataFrame:
    """Quartiles of all gaps and of interior gaps, in metres."""
    hist = gap_rows.groupBy("is_edge", "length").agg(F.count(F.lit(1)).alias("c"))
    both = hist.select("length", "c", F.explode(
        F.when(F.col("is_edge"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("interior")))
    ).alias("scope"))
    return both.groupBy("scope").agg(F.sum("c").alias("n"), _quartiles(step).alias("q")).select(
        "scope", "n", *[F.round(F.col("q")[i], 1).alias(f"{name}_m") for i, name in enumerate(QUARTILES)])


def gaps_per_well(gap_rows: DataFrame) -> DataFrame:
    """Number of gaps of each well."""
    return gap_rows.groupBy("well").agg(F.count(F.lit(1)).alias("n_gaps"))
