"""Consolidate per-cell metric shards as they arrive.

A replayed fold writes its rows again; the consolidated table keeps the last version of each
cell.  Each micro-batch rewrites only the (seed, method) partitions it touches.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.reports import keep_last
from ..session import path_exists, scratch_path

SCHEMA = "seed int, method string, scenario string, fold int, log string, r2 double, mae double"
CELL = ("seed", "method", "scenario", "fold", "log")


def consolidate(spark: SparkSession, shard_dir: str, table_dir: str, state_dir: str) -> StreamingQuery:
    """Start an available-now run that folds every unseen shard into ``table_dir``."""
    shards = (spark.readStream.schema(SCHEMA).option("header", True).csv(shard_dir)
              .withColumn("source", F.col("_metadata.file_path")).withColumn("written", F.col("_metadata.file_modification_time")))

    def upsert(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        new = batch
        if path_exists(session, table_dir):           # a table that cannot be read must fail the batch, not lose its rows
            old = session.read.parquet(table_dir)
            touched = batch.select("seed", "method").distinct()
            new = old.join(touched, ["seed", "method"], "left_semi").select(*batch.columns).unionByName(batch)
        merged = keep_last(new, ["written", "source"], CELL)
        # staged in the shared folder first: the table being replaced is also being read
        stage = scratch_path(session, f"shards-{epoch}-{zlib.crc32(table_dir.encode())}")
        merged.write.mode("overwrite").parquet(stage)
        (session.read.parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("seed", "method").parquet(table_dir))

    return (shards.writeStream.foreachBatch(upsert).option("checkpointLocation", state_dir).trigger(availableNow=True).start())
