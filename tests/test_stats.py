"""Tests, distributions, bootstrap and sufficient statistics against hand-made numbers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapwright.functions.distributions import chi2_sf, range_sf, t_ppf, t_sf2, wilcoxon_exact_p
from gapwright.operators import bootstrap as bs
from gapwright.operators import metrics as mt
from gapwright.operators import significance as sg
from gapwright.plans import reports as rp


@pytest.mark.parametrize("chi2,k,p", [(420.2532, 28, 3.694e-72), (217.5325, 28, 1.094e-31), (253.0092, 28, 1.405e-38),
                                      (317.6929, 28, 2.130e-51), (154.3054, 28, 8.458e-20), (54.6364, 11, 3.692e-08)])
def test_chi_square_tail(chi2, k, p):
    assert chi2_sf(chi2, k - 1) == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize("w,p", [(84, 0.9661), (75, 0.6705), (65, 0.3927), (45, 0.08143), (7, 0.000145), (0, 7.629e-06),
                                 (14, 0.0008392), (52, 0.154), (24, 0.0056), (35, 0.02685), (69, 0.4951)])
def test_exact_signed_rank_tail(w, p):
    assert wilcoxon_exact_p(w, 18) == pytest.approx(p, rel=2e-3)


def test_student_and_range():
    assert t_ppf(0.975, 4) == pytest.approx(2.7764451, rel=1e-6)
    assert t_sf2(2.228139, 10) == pytest.approx(0.05, rel=1e-5)
    assert range_sf(3.314, 3) == pytest.approx(0.05, abs=2e-4)      # published 5 % points, infinite df
    assert range_sf(4.474, 10) == pytest.approx(0.05, abs=2e-4)


def test_holm_textbook(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, None])], "f string, i int, p double")
    got = {r.i: r for r in sg.holm(df, ["f"]).collect()}
    assert [got[i].p_holm for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert [got[i].reject for i in range(5)] == [True, False, False, True, False] and got[4].p_holm is None


def _points(spark):
    rng = np.random.default_rng(5)
    rows = []
    for m, noise in (("mean", 1.0), ("locf", 0.3), ("mice", 0.5), ("stgnn", 0.6)):
        t_rng = np.random.default_rng(9)
        for seed in (0, 1):
            for w in range(7):
                for lg, s, mu in (("GR", 30, 60), ("RHOB", 0.2, 2.4), ("NPHI", 0.1, 0.2)):
                    t = t_rng.normal(size=25) * s + mu
                    for a, b in zip(t + rng.normal(size=25) * noise * s, t):
                        rows.append((m, seed, seed, "profile", lg, w, float(a), float(b)))
    return spark.createDataFrame(rows, "method string, init_seed int, mask_seed int, scenario string, log string, well int, pred double, truth double")


@pytest.fixture(scope="module")
def points(spark):
    return _points(spark).persist()


def test_point_metrics_cases(spark):
    rows = [("exact", v, v) for v in (1.0, 2.0, 3.0, 4.0)] + [("mean", 2.5, v) for v in (1.0, 2.0, 3.0, 4.0)] + [("flat", 1.0, 3.0)] * 3
    df = spark.createDataFrame(rows, "k string, pred double, truth double").withColumn("log", F.lit("GR"))
    got = {r.k: r for r in mt.point_metrics(df, ["k"]).where("log = 'all'").collect()}
    assert got["exact"].r2 == 1.0 and got["mean"].r2 == pytest.approx(0, abs=1e-12) and got["mean"].cc is None
    assert got["flat"].r2 is None and got["flat"].mae == 2.0


def test_stats_equal_direct_metrics(points):
    suff = mt.sufficient_stats(points)
    a = mt.pooled_from_stats(suff).toPandas().set_index(["method", "init_seed", "log"]).sort_index()
    b = mt.point_metrics(points, mt.CELL).where("log <> 'all'").toPandas().set_index(["method", "init_seed", "log"]).sort_index()
    for c in ("r2", "mae", "rmse"):
        np.testing.assert_allclose(a[c], b[c], rtol=1e-9)


def test_main_table_ranks_by_noise(points):
    suff = mt.sufficient_stats(points)
    t = {r.method: r for r in rp.main_table(suff, mt.fallback_sigma(suff)).collect()}
    assert [t[m].rank_r2_macro for m in ("locf", "mice", "stgnn", "mean")] == [1, 2, 3, 4]


def test_friedman_wilcoxon_direction(spark, points):
    suff = mt.sufficient_stats(points)
    err = sg.seed_average(mt.nrmse_per_well(suff, mt.fallback_sigma(suff))).persist()
    f = sg.with_p(sg.friedman_wells(err)).first()
    assert f.k_methods == 4 and f.n_blocks == 7 and 0 < f.kendall_W <= 1 and f.p < 0.01
    w = sg.wilcoxon(sg.paired(err, sg.pair_table(spark, {"profile": [("locf", "mean"), ("mean", "locf")]}))).collect()
    a, b = sorted(w, key=lambda r: r.pair_ord)
    assert a.rank_biserial == -1.0 and b.rank_biserial == 1.0 and a.W_stat == 0 and a.p == pytest.approx(2 / 2 ** 7)


def test_bootstrap_matches_sums_over_its_draws(spark, points):
    suff = mt.sufficient_stats(points).persist()
    pairs = sg.pair_table(spark, {"profile": [("locf", "mean"), ("mice", "stgnn")]})
    got = {(r.A, r.B): r for r in bs.delta_bootstrap(suff, pairs, reps=60, seed=11).collect()}
    pdf = suff.toPandas()

    def macro(m, s, wts):
        out = []
        for lg in ("GR", "RHOB", "NPHI"):
            g = pdf[(pdf.method == m) & (pdf.init_seed == s) & (pdf.log == lg)].sort_values("well")
            a = (g[["n", "sum_y", "sum_y2", "sse"]].to_numpy(float) * wts[:, None]).sum(0)
            out.append(1 - a[3] / (a[2] - a[1] ** 2 / a[0]))
        return np.mean(out)

    for k, (a, b) in enumerate((("locf", "mean"), ("mice", "stgnn"))):
        d = []
        for w in next(bs._multiplicities(7, 0, bs.BLOCK, 60, 11, k))[1].astype(float):
            assert w.sum() == 7
            d.append(np.mean([macro(a, s, w) - macro(b, s, w) for s in (0, 1)]))
        lo, hi = np.percentile(d, [2.5, 97.5])
        assert got[a, b].ci_lo == pytest.approx(lo, rel=1e-9) and got[a, b].ci_hi == pytest.approx(hi, rel=1e-9)


def test_bootstrap_blocks_split_the_draw_exactly():
    n, reps = 300, 400
    parts = {size: np.concatenate([np.concatenate([w for _, w in bs._multiplicities(n, b, size, reps, 4, 0)]) for b in range(-(-n // size))], axis=1)
             for size in (64, 128, 4096)}
    whole = parts[64]
    assert all((p == whole).all() for p in parts.values())          # the same draw however wells are cut into tasks
    assert whole.shape == (reps, n) and (whole.sum(1) == n).all()
    assert whole.mean() == pytest.approx(1.0) and whole.var() == pytest.approx(1 - 1 / n, abs=0.05)


def test_weights_equal_duplicated_wells(spark, points):
    suff = mt.sufficient_stats(points)
    mult = spark.createDataFrame([(0, 2), (2, 1), (3, 1)], "well int, weight int")
    a = mt.weighted_stats(suff, mult, ["method", "init_seed", "log"]).withColumn("r2", mt.r2_from_stats()).toPandas()
    dup = points.join(mult, "well").withColumn("_x", F.explode(F.sequence(F.lit(1), F.col("weight"))))
    b = dup.groupBy("method", "init_seed", "log").agg(*mt.metric_columns()).toPandas()
    key = ["method", "init_seed", "log"]
    np.testing.assert_allclose(a.sort_values(key)["r2"], b.sort_values(key)["r2"], rtol=1e-9)


def test_spearman_and_ci(spark):
    pdf = pd.DataFrame({"k": "x", "a": [1.0, 2, 3, 4, 5, 6], "b": [2.0, 1, 4, 3, 6, 5]})
    r = sg.spearman(spark.createDataFrame(pdf), ["k"], "a", "b").first()
    assert r.rho == pytest.approx(0.8285714) and r.p == pytest.approx(0.0415627, rel=1e-4)
    ci = sg.mean_sd_ci(spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 1.0)], "k string, v double"), ["k"], "v").toPandas().set_index("k")
    assert ci.loc["x", "ci_low"] == pytest.approx(1.5 - 12.7062 * 0.70710678 / 2 ** 0.5, rel=1e-4)
    assert np.isnan(ci.loc["y", "ci_low"]) and ci.loc["y", "std"] == 0
