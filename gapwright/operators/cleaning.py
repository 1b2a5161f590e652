"""Depth quality control, unit harmonisation, physical bounds, coverage, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (ABERRANT_GR_MEDIAN, BOUNDS, LOGS, PERCENT_P99, STEP_M, STEP_TOL, WINDOW)
from ..functions.ordered import carry
from ..functions.ranks import exact_percentiles

COLS = [c.lower() for c in LOGS]


def depth_steps(samples: DataFrame) -> DataFrame:
    """(well, step): difference of each depth to the one above it."""
    s = samples.select("well", "chunk", "idx", "depth")
    prev = carry(s, ["well"], "idx", ["depth"], strict=True)
    return prev.select("well", (F.col("depth") - F.col("prev_depth")).alias("step")).where("step IS NOT NULL")


def depth_qc(samples: DataFrame, step: float = STEP_M, tol: float = STEP_TOL) -> DataFrame:
    """Per-well depth-step report and verdict (``kept`` / ``EXCLUDED``).

    Jumps are steps above twice the well's own median; a well without any step is excluded.
    """
    steps = depth_steps(samples)
    med = exact_percentiles(steps, ["well"], "step", {"median_step_m": 0.5}).drop("n")
    jump = F.col("step") > 2 * F.col("median_step_m")
    stats = (
        steps.join(med, "well").groupBy("well").agg(
            F.first("median_step_m").alias("median_step_m"),
            F.min("step").alias("min_step_m"), F.max("step").alias("max_step_m"),
            F.sum((F.col("step") <= 0).cast("bigint")).alias("n_nonpos"),
            F.sum(jump.cast("bigint")).alias("n_jumps"),
            F.coalesce(F.sum(F.when(jump, F.col("step") - F.col("median_step_m"))), F.lit(0.0)).alias("jump_m"))
    )
    wells = samples.select("well").distinct()
    ok = ((F.abs(F.col("median_step_m") - step) <= tol)
          & (F.col("n_nonpos") == 0) & (F.col("n_jumps") == 0))
    return wells.join(stats, "well", "left").select(
        "well", "median_step_m", "min_step_m", "max_step_m",
        F.coalesce("n_nonpos", F.lit(0)).alias("n_nonpos"),
        F.coalesce("n_jumps", F.lit(0)).alias("n_jumps"),
        F.coalesce("jump_m", F.lit(0.0)).alias("jump_m"),
        F.when(ok, "kept").otherwise("EXCLUDED").alias("status"))


def drop_failing(samples: DataFrame, qc: DataFrame) -> DataFrame:
    """Samples of the wells that passed depth QC."""
    return samples.join(qc.where("status = 'EXCLUDED'").select("well"), "well", "left_anti")


def harmonise(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean the three channels; returns (clean samples, actions).

    Percent porosity is divided by 100, an aberrant gamma ray is dropped whole, values
    strictly outside the physical bounds become missing.  ``actions`` has one row per
    (well, log) with the action text and the number of removed samples.
    """
    p99 = exact_percentiles(samples, ["well"], "nphi", {"p99": 0.99}).select("well", "p99")
    med = exact_percentiles(samples, ["well"], "gr", {"gr_med": 0.5}).select("well", "gr_med")
    wide = samples.join(p99.join(med, "well", "full"), "well", "left")
    percent = F.coalesce(F.col("p99") > PERCENT_P99, F.lit(False))
    aberrant = F.coalesce(F.col("gr_med") < ABERRANT_GR_MEDIAN, F.lit(False))
    wide = (
        wide.withColumn("nphi", F.when(percent, F.col("nphi") / 100.0).otherwise(F.col("nphi")))
        .withColumn("gr", F.when(~aberrant, F.col("gr")))
    )
    out = {c: _outside(c) for c in COLS}
    flags = wide.groupBy("well").agg(
        F.first(percent).alias("percent"), F.first(aberrant).alias("aberrant"),
        F.first("gr_med").alias("gr_med"),
        *[F.coalesce(F.sum(out[c].cast("bigint")), F.lit(0)).alias(f"out_{c}") for c in COLS])
    clean = wide.select(
        "well", "idx", "chunk", "depth",
        *[F.when(~F.coalesce(out[c], F.lit(False)), F.col(c)).alias(c) for c in COLS])
    rows = []
    for c in COLS:
        lo, hi = BOUNDS[c.upper()]
        parts = [
            F.when(F.col("percent"), F.lit("/100(%->frac)")) if c == "nphi" else F.lit(None).cast("string"),
            F.when(F.col("aberrant"), F.format_string("EXCLUDED(GR median=%.1f<6, aberrant)", "gr_med"))
            if c == "gr" else F.lit(None).cast("string"),
            F.when(F.col(f"out_{c}") > 0, F.concat(F.lit(f"bounds[{lo},{hi}]:-"), F.col(f"out_{c}").cast("string"))),
        ]
        text = F.concat_ws("; ", *parts)
        rows.append(F.struct(F.lit(c.upper()).alias("log"),
                             F.when(text == "", "ok").otherwise(text).alias("action"),
                             F.col(f"out_{c}").alias("n_out")))
    actions = flags.select("well", F.inline(F.array(*rows)))
    return clean, actions


def _outside(c: str) -> Column:
    lo, hi = BOUNDS[c.upper()]
    return (F.col(c) < lo) | (F.col(c) > hi)


def coverage(samples: DataFrame, digits: int = 1) -> DataFrame:
    """(well, log, coverage_pct): share of measured samples in percent."""
    agg = samples.groupBy("well").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in COLS])
    return agg.select("well", F.inline(F.array(*[
        F.struct(F.lit(c.upper()).alias("log"),
                 F.round(F.col(c) / F.col("n") * 100.0, digits).alias("coverage_pct")) for c in COLS])))


def complete(*cols: str) -> Column:
    """True where every named channel is measured."""
    cond = F.lit(True)
    for c in cols or COLS:
        cond = cond & F.col(c).isNotNull()
    return cond


def triplet_wells(samples: DataFrame, min_samples: int = WINDOW) -> DataFrame:
    """Wells with more than ``min_samples`` depth samples carrying all channels."""
    return (samples.where(complete()).groupBy("well").agg(F.count(F.lit(1)).alias("n_complete"))
            .where(F.col("n_complete") > min_samples))


def quality_report(coverage_df: DataFrame, actions: DataFrame, picks: DataFrame | None,
                   qc: DataFrame) -> DataFrame:
    """Rows (well, log, mnemo_source, action, coverage_%), rejected wells included."""
    body = coverage_df.join(actions.drop("n_out"), ["well", "log"])
    if picks is not None:
        body = body.join(picks.select("well", "log", "mnemonic"), ["well", "log"], "left")
    else:
        body = body.withColumn("mnemonic", F.col("log"))
    absent = F.col("mnemonic").isNull()
    kept = body.select(
        "well", "log", F.coalesce("mnemonic", F.lit("ABSENT")).alias("mnemo_source"),
        F.when(absent, F.lit("")).otherwise(F.col("action")).alias("action"),
        F.when(absent, F.lit(0.0)).otherwise(F.col("coverage_pct")).alias("coverage_%"))
    gone = qc.where("status = 'EXCLUDED'").select(
        "well", F.lit("DEPTH").alias("log"), F.lit("").alias("mnemo_source"),
        F.format_string("EXCLUDED(step median=%.4f m, jumps=%d, nonpos=%d)",
                        "median_step_m", "n_jumps", "n_nonpos").alias("action"),
        F.lit(0.0).alias("coverage_%"))
    return kept.unionByName(gone)
