"""Session defaults and lineage control."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gapwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling and Arrow transfer.

    ``master`` is only given for local runs; on a cluster the submitter decides.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """Local session for tests and the bench."""
    base = {
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
    }
    return build_session("gapwright-local", f"local[{cpus}]", **{**base, **conf})


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` decides.  Only where it is unset and the session is local
    (tests) a scratch folder is made; a cluster without the setting is an error, because
    a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if current.isDefined():
        return named or current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="gapwright-ckpt-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver has collected what refers to them; a driver with little to do collects seldom, so it is asked to.
    """
    spark._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` that does not keep what was shuffled for it."""
    df = cut_lineage(df)
    released(df.sparkSession)
    return df


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table beside the checkpoints: what it was made of is neither kept nor made again."""
    spark = df.sparkSession
    path = scratch_path(spark, f"stored-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    released(spark)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table beside the checkpoints."""
    return os.path.join(checkpoint_dir(spark), name)
