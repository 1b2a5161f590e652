"""Well samples derived from star-schema tables.

``lineitem`` becomes depth-ordered samples (supplier = well), ``events`` becomes an
irregular depth axis, ``supplier`` becomes well coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import STEP_M
from ..functions.ordered import CHUNK, ordinal, with_chunk

#: order keys per slab: bounds the rows one numbering task can see, whatever the table size
ORDER_SLAB = 65_536


def samples_raw(spark: SparkSession, sf_dir: str, chunk: int = CHUNK) -> DataFrame:
    """(well, idx, chunk, depth, gr, rhob, nphi) with every channel measured."""
    li = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                "l_quantity", "l_shipdate", "l_discount")
        .withColumnRenamed("l_suppkey", "well")
        .withColumn("_slab", F.expr(f"l_orderkey div {ORDER_SLAB}"))
    )
    numbered = ordinal(li, ["well"], "_slab",
                       ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
                        "l_shipdate"], "idx")
    return with_chunk(numbered.select(
        "well", "idx",
        (F.lit(1000.0) + F.col("idx") * STEP_M).alias("depth"),
        (F.col("l_quantity") * 4.0).alias("gr"),
        (F.lit(1.9) + F.col("l_extendedprice") / 105000.0).alias("rhob"),
        (F.col("l_discount") * 5.0 + 0.02).alias("nphi"),
    ), size=chunk)


def _with_gaps(raw: DataFrame) -> DataFrame:
    h = F.expr("(well * 31 + (idx div 37) * 17) % 11")
    late = F.expr("idx >= 400 + well % 50")
    return raw.select(
        "well", "idx", "chunk", "depth",
        F.when(~(late & h.isin(0, 1)), F.col("gr")).alias("gr"),
        F.when(~(late & h.isin(1, 2, 3, 4)), F.col("rhob")).alias("rhob"),
        F.when(~(late & h.isin(1, 2, 3, 4)), F.col("nphi")).alias("nphi"),
    )


def well_samples(spark: SparkSession, sf_dir: str, chunk: int = CHUNK) -> DataFrame:
    """Samples with rule-based gaps: the cleaned input of every downstream operator."""
    return _with_gaps(samples_raw(spark, sf_dir, chunk))


def samples_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples before cleaning: percent porosity, aberrant gamma ray, out-of-range spikes."""
    s = well_samples(spark, sf_dir)
    spike = F.expr("idx % 97 = 0 AND well % 3 = 0")
    return s.select(
        "well", "idx", "chunk", "depth",
        F.when(spike & F.col("gr").isNotNull(), F.lit(450.0))
        .when(F.expr("well % 13 = 5"), F.col("gr") / 40.0).otherwise(F.col("gr")).alias("gr"),
        "rhob",
        F.when(F.expr("well % 7 = 3"), F.col("nphi") * 100.0).otherwise(F.col("nphi")).alias("nphi"),
    )


def event_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An irregular depth axis: one user per well, epoch seconds as depth."""
    ev = (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .select(F.col("user_id").alias("well"), "event_id",
                (F.expr("unix_micros(CAST(ts AS TIMESTAMP))") / 1e6).alias("depth"))
        .withColumn("_slab", F.expr("CAST(floor(depth / 3600) AS BIGINT)"))
    )
    return with_chunk(ordinal(ev, ["well"], "_slab", ["depth", "event_id"], "idx")
                      .select("well", "idx", "depth"))


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(well, x, y) in metres: a ten-column lattice with an integer jitter."""
    k = "s_suppkey"
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col(k).alias("well"),
        F.expr(f"CAST(100000 + 2000 * ({k} % 10) + 7 * (({k} * {k}) % 97) AS DOUBLE)").alias("x"),
        F.expr(f"CAST(200000 + 2000 * ({k} div 10) + 11 * (({k} * {k} * {k}) % 89) AS DOUBLE)").alias("y"),
    )
