"""LAS 2.0 text files as a distributed scan.

Files are read line by line (a file splits over tasks like any text), so one very large well
does not land in one task.  Section headers are located with a per-file minimum and data
lines are numbered by their byte-order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LOGS, MNEMONICS
from ..functions.ordered import CHUNK, ordinal, with_chunk


def read_lines(spark: SparkSession, las_dir: str) -> DataFrame:
    """(well, pos, line) of every ``*.las`` file; ``pos`` grows along the file.

    The position is the pair (file block start, row inside the scan task), so it needs no
    global pass.  Fails when the folder holds no LAS file.
    """
    raw = spark.read.option("pathGlobFilter", "*.las").text(las_dir)
    return raw.select(
        F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.las$", "").alias("well"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("row")).alias("pos"),
        F.col("value").alias("line"))


def sections(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(curve headers, null values, data lines) of each file."""
    marks = lines.where(F.col("line").startswith("~")).select("well", "pos", F.upper(F.substring("line", 2, 1)).alias("sec"))
    # a file has a handful of section headers: one small row per file, joined to its lines
    heads = marks.groupBy("well").agg(F.array_sort(F.collect_list(F.struct("pos", "sec"))).alias("heads"))
    body = lines.where(~F.col("line").startswith("~") & (F.trim("line") != "") & ~F.col("line").startswith("#"))
    placed = body.join(heads, "well").withColumn(
        "sec", F.element_at(F.filter("heads", lambda h: h["pos"] < F.col("pos")), -1)["sec"]).drop("heads")
    curve = placed.where("sec = 'C'").select("well", "pos", F.upper(F.trim(F.regexp_extract("line", r"^\s*([^.\s]+)\s*\.", 1))).alias("mnemonic"))
    curve = ordinal(curve.withColumn("_slab", F.lit(0)), ["well"], "_slab", ["pos"], "col").select("well", "col", "mnemonic")
    null = (placed.where("sec = 'W'").where(F.upper("line").rlike(r"^\s*NULL\s*\."))
            .groupBy("well").agg(F.first(F.regexp_extract("line", r"\.\S*\s+([-+0-9.eE]+)", 1).cast("double")).alias("null_value")))
    return curve, null, placed.where("sec = 'A'").select("well", "pos", "line")


def pick_curves(curve: DataFrame) -> DataFrame:
    """(well, log, mnemonic, col): the accepted mnemonic of highest priority, if any."""
    rows = [(log, m, i) for log in LOGS for i, m in enumerate(MNEMONICS[log])]
    prefs = curve.sparkSession.createDataFrame(rows, "log string, mnemonic string, prio int")
    return curve.join(prefs, "mnemonic").groupBy("well", "log").agg(
        F.min_by("mnemonic", "prio").alias("mnemonic"), F.min_by("col", F.struct("prio", -F.col("col"))).alias("col"))


def read_las(spark: SparkSession, las_dir: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(samples, picks): raw samples (well, idx, chunk, depth, gr, rhob, nphi) and the chosen curves.

    Missing columns, short lines and the file's NULL value become NULL.
    """
    lines = read_lines(spark, las_dir)
    if lines.isEmpty():
        raise FileNotFoundError(f"no *.las file in {las_dir}")
    curve, null, data = sections(lines)
    picks = pick_curves(curve)
    wide = picks.groupBy("well").pivot("log", list(LOGS)).agg(F.first("col"))
    wide = wide.select("well", *[F.col(lg).alias(f"c_{lg}") for lg in LOGS])
    numbered = ordinal(data.withColumn("_slab", F.col("pos.block")), ["well"], "_slab", ["pos"], "idx")
    vals = numbered.select("well", "idx", F.split(F.trim("line"), r"\s+").alias("v")).join(wide, "well", "left").join(null, "well", "left")

    def num(pos):
        x = F.try_element_at("v", (pos + 1).cast("int")).try_cast("double")
        return F.when(F.isnan(x) | (x == F.col("null_value")), None).otherwise(x)

    out = vals.select("well", "idx", num(F.lit(0)).alias("depth"),
                      *[F.when(F.col(f"c_{lg}").isNotNull(), num(F.coalesce(f"c_{lg}", F.lit(0)))).alias(lg.lower()) for lg in LOGS])
    return with_chunk(out, size=chunk), picks
