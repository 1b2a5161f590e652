"""LAS to dataset, stores, replication, streaming, documents."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwright.plans.dataset import build_dataset
from gapwright.plans.replication import replicate
from gapwright.sinks import store
from gapwright.sources import files, las
from gapwright.sources import tables as tb
from gapwright.streaming.shards import consolidate

HEAD = """~Version Information
VERS.   2.0 : CWLS LOG ASCII STANDARD
WRAP.    NO : ONE LINE PER DEPTH STEP
~Well Information
NULL.  -999.25 : NULL VALUE
~Curve Information
DEPT.M    : DEPTH
{curves}
~ASCII
"""


def write(path, depth, cols):
    rng = np.random.default_rng(0)
    n = len(depth)
    body = {"GR": 80 + rng.normal(0, 3, n), "CGR": 50 + rng.normal(0, 3, n), "DEN": 2.4 + rng.normal(0, 0.02, n), "NPHI": 25 + rng.normal(0, 1, n)}
    lines = [" ".join(["%.4f" % d] + ["-999.2500" if c == "DEN" and i < 20 else "%.4f" % body[c][i] for c in cols]) for i, d in enumerate(depth)]
    path.write_text(HEAD.format(curves="\n".join(f"{c}.U : {c}" for c in cols)) + "\n".join(lines) + "\n")
    return body


@pytest.fixture(scope="module")
def las_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("las")
    regular = 1000 + np.arange(600) * 0.1524
    for i in range(3):
        write(d / f"W{i}.las", regular, ["CGR", "GR", "DEN", "NPHI"])
    write(d / "BAD.las", np.r_[1741 + np.arange(300) * 0.5, 1741 + 300 * 0.5 + 72.5 + np.arange(300) * 0.5], ["GR", "DEN", "NPHI"])
    write(d / "PART.las", regular[:300], ["DEN", "NPHI"])
    return d


def test_las_reader(spark, las_dir):
    samples, picks = las.read_las(spark, str(las_dir), chunk=64)
    w = samples.where("well = 'W0'").toPandas().sort_values("idx")
    assert len(w) == 600 and (w["idx"].to_numpy() == np.arange(600)).all()
    np.testing.assert_allclose(w["depth"], np.round(1000 + np.arange(600) * 0.1524, 4))
    assert abs(w["gr"].mean() - 80) < 1 and w["rhob"].isna().sum() == 20 and w["rhob"][:20].isna().all()
    got = {(r.well, r.log): r.mnemonic for r in picks.collect()}
    assert got["W0", "GR"] == "GR" and got["W0", "RHOB"] == "DEN" and ("PART", "GR") not in got


def test_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        las.read_las(spark, str(tmp_path))


def test_build_dataset(spark, las_dir, tmp_path):
    out = build_dataset(spark, str(las_dir), str(tmp_path / "ds"))
    assert {r.test_well for r in out["folds"].collect()} == {"W0", "W1", "W2"}
    qc = {r.well: r.status for r in out["depth_qc"].collect()}
    assert qc["BAD"] == "EXCLUDED" and qc["W0"] == "kept"
    q = {(r["well"], r["log"]): r for r in spark.read.option("header", True).csv(str(tmp_path / "ds/quality_report")).collect()}
    assert q["W0", "NPHI"]["action"] == "/100(%->frac)" and q["BAD", "DEPTH"]["action"].startswith("EXCLUDED(step median=0.5000")
    assert q["PART", "GR"]["mnemo_source"] == "ABSENT"
    doc = json.loads(spark.read.text(str(tmp_path / "ds/missingness")).first().value)
    assert doc["cooccur_pct_samples"]["1_logs"] == 100.0 and doc["gap_length_m"]["all"]["n"] == 3
    assert spark.read.parquet(str(tmp_path / "ds/windows")).count() == out["windows"].count() > 0


def test_replication_resumes(spark, sf, tmp_path):
    s = tb.well_samples(spark, sf)
    path = str(tmp_path / "pool")
    assert replicate(s, path, ["mean"], [0], scenarios=["block"]) == 1
    assert replicate(s, path, ["mean", "locf"], [0], scenarios=["block"]) == 1
    assert replicate(s, path, ["mean", "locf"], [0], scenarios=["block"]) == 0
    p = store.read_pool(spark, path)
    assert {r.method for r in p.select("method").distinct().collect()} == {"mean", "locf"}
    assert p.groupBy("method").count().select("count").distinct().count() == 1
    assert replicate(s, path, ["mean", "locf"], [0], scenarios=["block", "single"]) == 2          # a scenario added later
    assert {r.scenario for r in store.read_pool(spark, path).select("scenario").distinct().collect()} == {"block", "single"}


def test_shards_keep_last(spark, tmp_path):
    src, out = tmp_path / "raw", str(tmp_path / "table")
    src.mkdir()
    head = "seed,method,scenario,fold,log,r2,mae\n"
    (src / "a.csv").write_text(head + "0,mean,block,0,GR,0.1,1\n0,mean,block,1,GR,0.2,1\n")
    consolidate(spark, str(src), out, str(tmp_path / "state")).awaitTermination()
    (src / "b.csv").write_text(head + "0,mean,block,1,GR,0.9,1\n0,locf,block,0,GR,0.5,1\n")
    consolidate(spark, str(src), out, str(tmp_path / "state")).awaitTermination()
    got = {(r.method, r.fold): r.r2 for r in spark.read.parquet(out).collect()}
    assert got == {("mean", 0): 0.1, ("mean", 1): 0.9, ("locf", 0): 0.5}


def test_shards_fail_when_the_table_cannot_be_read(spark, tmp_path):
    src, out = tmp_path / "raw", tmp_path / "table"
    src.mkdir()
    out.mkdir()
    (out / "part-0.parquet").write_text("not a parquet file")
    (src / "a.csv").write_text("seed,method,scenario,fold,log,r2,mae\n0,mean,block,0,GR,0.1,1\n")
    with pytest.raises(Exception):
        consolidate(spark, str(src), str(out), str(tmp_path / "state")).awaitTermination()
    assert (out / "part-0.parquet").exists()


def test_documents_and_settings(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("mean_x", -0.5, True), ("locf", None, False)], "method string, r2 double, best boolean")
    assert "| mean_x | -0.500 |" in store.markdown_table(df, ["method", "r2"])
    assert r"\textbf{mean\_x} & \textbf{$-$0.500}" in store.latex_table(df, ["method", "r2"], bold="best")
    c = {r["column"]: r for r in store.compare_tables(df, df.withColumn("r2", F.col("r2") + 0.25), ["method"], ["best"]).collect()}
    assert c["r2"].max_abs_diff == 0.25 and c["best"].n_different == 0
    assert files.resolve("data_dir", root="/r") == "/r/data/processed"
    monkeypatch.setenv("GAPWRIGHT_DATA_DIR", "/env")
    assert files.resolve("data_dir") == "/env" and files.resolve("data_dir", "/arg") == "/arg"
    store.run_metadata(spark, str(tmp_path / "m"), seeds=[0])
    assert spark.read.json(str(tmp_path / "m")).first()["settings"]["seeds"] == "[0]"


def test_error_stats_label_check(spark, tmp_path):
    head = "method,scenario,init_seed,mask_seed,rep,log,fold,well,n,sum_y,sum_y2,sse,sae\n"
    (tmp_path / "ok.csv").write_text(head + "mean,block,0,0,0,GR,0,W01,2,1,1,1,1\nmean,block,0,0,1,GR,0,W01,3,1,1,1,1\n")
    assert files.read_error_stats(spark, str(tmp_path / "ok.csv")).first().n == 5
    (tmp_path / "bad.csv").write_text(head + "mean,block,0,0,0,GR,0,W07,2,1,1,1,1\n")
    with pytest.raises(Exception, match="does not match"):
        files.read_error_stats(spark, str(tmp_path / "bad.csv")).collect()
