"""LAS folder to analysed dataset in one lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import coverage, depth_qc, drop_failing, harmonise, quality_report, triplet_wells
from ..operators.missingness import code_runs, gaps, gaps_per_well, intervals, well_lengths
from ..operators.windows import folds, intact_windows
from ..session import cut_lineage
from ..sinks.store import missingness_document, write_csv, write_dataset
from ..sources.las import read_las


def build_dataset(spark: SparkSession, las_dir: str, out_dir: str) -> dict[str, DataFrame]:
    """Read, check, clean and window a LAS folder; write every artefact below ``out_dir``.

    Wells with an irregular depth axis are excluded; only wells with more than one window
    length of complete samples enter folds, windows and missingness statistics.
    """
    raw, picks = read_las(spark, las_dir)
    raw = cut_lineage(raw)
    qc = cut_lineage(depth_qc(raw))
    clean, actions = harmonise(drop_failing(raw, qc))
    clean = cut_lineage(clean)
    eligible = triplet_wells(clean).select("well")
    study = clean.join(eligible, "well", "left_semi")
    windows = intact_windows(study)
    report = quality_report(coverage(clean), actions, picks.join(clean.select("well").distinct(), "well", "left_semi"), qc)
    all_folds = folds(eligible)
    runs = code_runs(study)
    write_dataset(out_dir, {"well_samples": clean, "windows": windows, "folds": all_folds, "intervals": intervals(runs),
                            "gaps_per_well": gaps_per_well(gaps(runs, well_lengths(study)))})
    write_csv(report, f"{out_dir}/quality_report")
    write_csv(qc, f"{out_dir}/depth_qc")
    missingness_document(study).coalesce(1).write.mode("overwrite").text(f"{out_dir}/missingness")
    return {"samples": clean, "study": study, "windows": windows, "folds": all_folds, "quality": report, "depth_qc": qc}
