"""Steps that must not grow faster than their tables, on rows of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwright.constants import SCENARIOS
from gapwright.functions.ordered import with_chunk
from gapwright.operators import imputers as im
from gapwright.operators import metrics as mt
from gapwright.operators import scaling as sc
from gapwright.operators import spatial as sp
from gapwright.operators.metrics import sufficient_stats
from gapwright.plans import empirical as em
from gapwright.plans import evaluation as ev
from gapwright.plans import leakage as lk


@pytest.fixture(scope="module")
def rows(spark):
    wave = "CASE WHEN well = 2 AND idx >= 390 THEN NULL ELSE {} END"
    return with_chunk(spark.range(1200).selectExpr("id % 3 AS well", "id div 3 AS idx").selectExpr(
        "well", "idx", "75 + 30 * sin(idx / (7.0D + well)) AS gr", wave.format("2.4 + 0.2 * cos(idx * 0.37D + well)") + " AS rhob",
        "0.25 + 0.1 * sin(idx * idx * 0.11D) AS nphi")).persist()


def test_run_sums_equal_points(rows):
    key = ["method", "init_seed", "mask_seed", "scenario", "log", "well"]
    got = ev.evaluate_stats(rows, im.NATIVE, SCENARIOS, (0, 1))
    want = sufficient_stats(ev.evaluate(rows, im.NATIVE, SCENARIOS, (0, 1)))
    a, b = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) > 300 and (a[[*key, "n"]] == b[[*key, "n"]]).all().all()
    for c in ("sum_y", "sum_y2", "sse", "sae"):
        assert a[c].to_numpy() == pytest.approx(b[c].to_numpy(), rel=1e-9, abs=1e-9)


def test_masks_are_worked_off_in_the_partitions_of_the_windows(spark, rows):
    """The narrow rows of the fits must not decide how many tasks the masks have, and no position may become a row."""
    parts = im.run_sums(ev._specs(rows, ("mean", "locf"), SCENARIOS, (0, 1), 256, 64), ("mean", "locf"), 256)
    busy = parts.select(F.spark_partition_id().alias("p")).distinct().count()
    assert busy > 1
    assert parts.count() <= 9 * len(SCENARIOS) * 2        # at most one row for each mask of the 9 windows


def test_message_pass_tiles_equal_join(spark):
    feats = spark.range(4000).selectExpr("id % 20 AS well", "id div 20 + (id % 20) % 3 AS g", "CASE WHEN id % 7 = 0 THEN NULL ELSE id * 0.5D END AS gr",
                                         "CAST(id % 11 AS DOUBLE) AS rhob").where("NOT (well = 4 AND g < 90)")
    feats = feats.unionByName(feats.where("g = 50 AND well = 3"))
    graph = spark.range(100).selectExpr("id % 20 AS src", "(id % 20 + (id div 20) * 7) % 23 AS dst", "1 / (1D + id) AS weight")
    graph = graph.unionByName(graph.where("src = 5"))
    got = sp.message_pass(feats, graph, ["gr", "rhob"], tile=6, layer=16)
    want = graph.join(feats.withColumnRenamed("well", "dst"), "dst").groupBy(F.col("src").alias("well"), "g").agg(
        *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("gr", "rhob")])
    a, b = (x.toPandas().sort_values(["well", "g"]).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and (a[["well", "g"]] == b[["well", "g"]]).all().all()
    for c in ("gr", "rhob"):
        assert a[c].isna().equals(b[c].isna()) and a[c].to_numpy() == pytest.approx(b[c].to_numpy(), nan_ok=True)


def test_run_sums_of_a_log_that_no_run_masks(rows):
    specs = ev._specs(rows, ("mean",), ("single",), (0, 1, 2), 256, 64).where("mask_bits = 1")
    got = im.run_sums(specs, ("mean",), 256).collect()
    assert got and all(r.n_gr > 0 and r.n_rhob == 0 and r.y_rhob == r.sse_mean_nphi == 0.0 for r in got)


def test_metrics_from_moments_equal_those_of_points(rows):
    methods = ("mean", "locf", "interp_linear", "ridge")
    want = mt.point_metrics(ev.evaluate(rows, methods), ["method", "scenario"]).toPandas()
    got = ev.evaluate_metrics(rows, methods).toPandas()
    both = want.merge(got, on=["method", "scenario", "log"], suffixes=("", "_new"))
    assert len(want) == len(got) == len(both) and (both.n == both.n_new).all()
    for k in ("mae", "rmse", "r2", "cc"):
        assert np.allclose(both[k], both[f"{k}_new"], rtol=1e-9, atol=1e-12, equal_nan=True)
    keys = ["method", "scenario", "log"]
    want = mt.fold_mean_r2(ev.evaluate(rows, methods), keys).toPandas().sort_values(keys)
    got = ev.evaluate_fold_mean(rows, methods).toPandas().sort_values(keys)[want.columns]
    assert np.allclose(want[want.columns[3:]].astype(float), got[want.columns[3:]].astype(float), rtol=1e-9)


def test_moments_of_a_constant_have_no_spread(spark):
    parts = spark.createDataFrame([("a", n, 0.1, 0.0, 0.3, 0.0, 0.0, n * 0.04, n * 0.2) for n in (3, 7, 11)],
                                  "k string, n long, my double, vy double, mp double, vp double, vyp double, sse double, sae double")
    got = mt.metrics_of_moments(parts, ["k"]).first()
    assert got.n == 21 and got.r2 is None and got.cc is None and got.rmse == pytest.approx(0.2)


def test_alignment_counts_as_the_points_do(rows):
    pts = ev.evaluate(rows, ["mean", "locf"])
    want = {r.scenario: r.n for r in pts.where("method = 'mean'").groupBy("scenario").agg(F.count("truth").alias("n")).collect()}
    got = {r.scenario: (r.n, r.bad) for r in ev.alignment(rows, "mean", "locf").collect()}
    assert got == {s: (n, 0) for s, n in want.items()}


@pytest.mark.parametrize("piece", [64, 1024])
def test_empirical_points_at_any_piece_size(rows, piece, monkeypatch):
    monkeypatch.setattr(em, "PIECE", piece)
    methods = ("locf", "locf_win", "interp_linear")
    got = em.evaluate_empirical(rows, methods, 2).toPandas()
    masks, size = em.plan_masks(rows, 2).toPandas(), 256
    wells = {w: g.sort_values("idx") for w, g in rows.select("well", "idx", "gr", "rhob", "nphi").toPandas().groupby("well")}
    mu = {r.well: r for r in sc.fold_scaler(rows).toPandas().itertuples()}
    want = {}
    for m in masks.itertuples():
        g = wells[m.well]
        for i, c in enumerate(("gr", "rhob", "nphi")):
            if not m.mask_cols & (1 << i):
                continue
            y, at, mean = g[c].to_numpy(), g.idx.to_numpy(), getattr(mu[m.well], f"mu_{c}")
            x = np.where((at >= m.mask_from) & (at < m.mask_to), np.nan, y)
            live = np.flatnonzero(~np.isnan(x))
            starts = sorted({*range(m.seg_start, m.seg_end - size + 1, size // 2), m.seg_end - size})
            for t in range(m.mask_from, m.mask_to):
                k = int(np.flatnonzero(at == t)[0])
                key = (m.well, m.seg_start, m.rep, t, c.upper())
                above = live[live < k]
                want[(*key, "locf")] = x[above[-1]] if len(above) else mean
                want[(*key, "interp_linear")] = np.interp(t, at[live], x[live]) if len(live) else mean
                seen = [s for s in starts if s <= t < s + size]
                want[(*key, "locf_win")] = np.mean([x[above[-1]] if len(above) and at[above[-1]] >= s else mean for s in seen])
    assert len(got) == len(want) > 0
    for r in got.itertuples():
        assert r.pred == pytest.approx(want[(r.well, r.seg_start, r.rep, r.idx, r.log, r.method)], rel=1e-9)
    stats = em.empirical_stats(rows, methods, 2).toPandas()
    assert stats.n.sum() == len(got) and stats.sse.sum() == pytest.approx(((got.pred - got.truth) ** 2).sum())


def test_leakage_queries_read_the_masked_runs(rows):
    got = lk.leak_split_metrics(rows).toPandas()
    assert set(got.log) == {"GR", "RHOB", "NPHI", "all"} and (got.n > 0).all()
    d = lk.matched_experiment(rows).toPandas()
    assert d.groupby(["scenario", "log"]).n.nunique().max() == 1 and set(d.config) == {"A_window_overlap", "B_window_no_overlap", "D_well_split"}


def test_blanked_test_windows_leave_the_neighbour_grid(spark):
    """configuration C of the matched experiment against brute force: test windows cannot be read as neighbours."""
    import math

    from gapwright.operators import masking as mk
    from gapwright.operators import windows as wn
    size, stride, n, wells = 32, 16, 96, 9
    rng = np.random.default_rng(7)
    val = rng.normal(size=(wells, n, 3)) + np.arange(wells)[:, None, None]
    val[2:5, 40:44] = np.nan
    xy = rng.uniform(0, 5000, (wells, 2))
    s = spark.createDataFrame([(w, i, 0, 1000.0 + 0.1524 * i, *[None if math.isnan(v) else float(v) for v in val[w, i]]) for w in range(wells) for i in range(n)],
                              "well long, idx long, chunk long, depth double, gr double, rhob double, nphi double")
    co = spark.createDataFrame([(w, float(x), float(y)) for w, (x, y) in enumerate(xy)], "well long, x double, y double")
    got = lk.matched_experiment(s, size=size, stride=stride, test_frac=0.4, coords=co).toPandas().set_index(["method", "config", "scenario", "log"])
    configs = {"A_window_overlap", "B_window_no_overlap", "C_window_no_overlap_blanked", "D_well_split"}
    assert {k[:2] for k in got.index} == {(m, c) for m in ("ridge", "nnwell") for c in configs}
    windows = wn.intact_windows(s, size, stride)
    test = lk.train_sets(windows, test_frac=0.4)[0]
    blank = {(r.well, r.start + t) for r in test.collect() for t in range(size)}
    masked = mk.apply_masks(wn.window_samples(s, size, stride).join(test, ["well", "start"], "left_semi"), ["block", "profile"], (0,), size).where("mask_bits > 0").collect()
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    r2 = {}
    for config in ("B_window_no_overlap", "C_window_no_overlap_blanked"):
        points = {}
        for r in masked:
            for i, log in enumerate(("GR", "RHOB", "NPHI")):
                if r.mask_bits & (1 << i):
                    g = r.start + r.t
                    seen = [v for v in range(wells) if v != r.well and np.isfinite(val[v, g, i]) and not (config[0] == "C" and (v, g) in blank)]
                    points.setdefault((r.scenario, log), []).append((val[min(seen, key=lambda v: d[r.well, v]), g, i] if seen else None, val[r.well, g, i]))
        for (scenario, log), p in points.items():
            assert got.loc[("nnwell", config, scenario, log), "n"] == len(p)
            if all(a is not None for a, _ in p):
                a, y = np.array(p).T
                r2[config[0], scenario, log] = want = 1 - ((a - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()
                assert got.loc[("nnwell", config, scenario, log), "r2"] == pytest.approx(want)
    assert any(r2["B", *k[1:]] != pytest.approx(v) for k, v in r2.items() if k[0] == "C")


def test_spearman_numbers_the_samples_once(spark, sf, monkeypatch):
    """F8: all steps read one stored table; what they shuffled is let go of between them."""
    from gapwright.plans import catalogue as ct
    calls, let_go = [], []
    number, settle = ct.tb.well_samples, ct.settled
    monkeypatch.setattr(ct.tb, "well_samples", lambda *a, **kw: calls.append(a) or number(*a, **kw))
    monkeypatch.setattr(ct, "settled", lambda df: let_go.append(df.columns) or settle(df), raising=False)
    got = ct.QUERIES["spearman"](spark, sf)
    assert "rho" in got.columns and got.count() > 0
    assert len(calls) == 1 and any("n_avail" in c for c in let_go) and any("gain" in c for c in let_go)
