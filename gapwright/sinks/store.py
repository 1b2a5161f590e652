"""Tables on disk.  Writes go through Spark's committer, so a lost executor leaves no half file."""

from __future__ import annotations

import json
import platform
import subprocess
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

POOL_KEYS = ["init_seed", "mask_seed", "scenario", "method"]


def write_dataset(out: str, tables: dict[str, DataFrame]) -> None:
    """Write named tables below ``out`` as parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_pool(points: DataFrame, path: str) -> None:
    """Scored points partitioned by (init_seed, mask_seed, scenario, method); replaces only the written cells."""
    (points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*POOL_KEYS).parquet(path))


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Scored points; filters on seeds and method prune partitions.  Unlabelled points are refused."""
    df = spark.read.parquet(path)
    if "well" not in df.columns:
        raise ValueError(f"{path}: points carry no well label; write them again")
    return df


def finished(spark: SparkSession, path: str) -> set[tuple[int, int, str, str]]:
    """Cells already stored: one row per partition.  A store that is there but cannot be read is an error."""
    if not path_exists(spark, path):
        return set()
    rows = spark.read.parquet(path).groupBy(*POOL_KEYS).agg(F.lit(1)).collect()
    return {tuple(r[k] for k in POOL_KEYS) for r in rows}


def missingness_document(samples: DataFrame) -> DataFrame:
    """One JSON row of bounded size: co-occurrence, combinations and gap quartiles.

    Raw intervals and gaps per well grow with the data, so they are tables of their own.
    """
    from ..operators import missingness as ms
    runs = ms.code_runs(samples)
    iv, gaps = ms.intervals(runs), ms.gaps(runs, ms.well_lengths(samples))

    def one(df: DataFrame, name: str, key, value) -> DataFrame:
        return df.groupBy(F.lit(0).alias("_g")).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))

    s, i = ms.cooccur_samples(samples), ms.cooccur_intervals(iv)
    label = F.concat(F.col("k").cast("string"), F.lit("_logs"))
    parts = [
        one(s, "cooccur_pct_samples", label, F.col("pct")), one(i, "cooccur_pct_intervals", label, F.col("pct")),
        one(s, "cooccur_prob_sample", F.col("k").cast("string"), F.col("prob")),
        one(ms.combinations(iv), "combinations", F.col("combo"), F.struct("share_samples_pct", "share_intervals_pct", "p25_m", "p50_m", "p75_m", "p90_m")),
        one(ms.gap_quartiles(gaps), "gap_length_m", F.col("scope"), F.struct("p25_m", "p50_m", "p75_m", "p90_m", "n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "_g", "full")
    doc = out.drop("_g")
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("value"))


def run_metadata(spark: SparkSession, path: str, **extra) -> DataFrame:
    """One row that says which code made a run, when and with what settings; appended as JSON below ``path``.

    Goes through Spark's committer, so the folder may be in any store.
    """
    from .. import __version__
    code = subprocess.run(["git", "describe", "--always", "--dirty"], capture_output=True, text=True, check=False).stdout.strip()
    settings = {k: json.dumps(v) for k, v in extra.items()}
    row = spark.range(1).select(
        F.lit(code or None).cast("string").alias("code"), F.lit(__version__).alias("version"), F.lit(platform.python_version()).alias("python"),
        F.lit(spark.version).alias("spark"), F.current_timestamp().alias("at"), F.array(*map(F.lit, sys.argv[1:])).cast("array<string>").alias("arguments"),
        F.create_map(*[F.lit(x) for kv in settings.items() for x in kv]).cast("map<string,string>").alias("settings"))
    row.coalesce(1).write.mode("append").json(path)
    return row


def markdown_table(df: DataFrame, columns: Sequence[str], digits: int = 3) -> str:
    """A collected report (already aggregated to report size) as a Markdown table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in df.select(*columns).collect():
        lines.append("| " + " | ".join("n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines)


def latex_table(df: DataFrame, columns: Sequence[str], digits: int = 3, bold: str | None = None) -> str:
    """A collected report as a LaTeX tabular; rows where column ``bold`` is true are set bold."""
    def cell(v):
        if v is None:
            return "--"
        if isinstance(v, float):
            t = f"{v:.{digits}f}"
            return t.replace("-", "$-$", 1) if v < 0 else t
        return str(v).replace("_", r"\_")
    out = [r"\begin{tabular}{@{}" + "l" * len(columns) + r"@{}}", r"\toprule", " & ".join(c.replace("_", r"\_") for c in columns) + r" \\", r"\midrule"]
    for r in df.select(*columns, *([bold] if bold else [])).collect():
        cells = [cell(r[c]) for c in columns]
        if bold and r[bold]:
            cells = [rf"\textbf{{{c}}}" for c in cells]
        out.append(" & ".join(cells) + r" \\")
    return "\n".join([*out, r"\bottomrule", r"\end{tabular}"])


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], exact: Sequence[str] = ()) -> DataFrame:
    """Per shared column: rows compared, largest numeric difference, number of differing exact cells."""
    cols = [c for c in a.columns if c in b.columns and c not in keys]
    j = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols]), list(keys), "full")
    rows = []
    for c in cols:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        num = dict(a.dtypes)[c] not in ("string", "boolean")
        gap = F.max(F.abs(x - y)) if num and c not in exact else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), gap.cast("double").alias("max_abs_diff"),
                             F.sum((~x.eqNullSafe(y)).cast("bigint")).alias("n_different")))
    return j.agg(F.array(*rows).alias("r")).select(F.inline("r"))
