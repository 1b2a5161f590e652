"""Masks, imputers, spatial estimates and learners against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwright.constants import SCENARIOS, eval_seed
from gapwright.operators import imputers as im
from gapwright.operators import masking as mk
from gapwright.operators import scaling as sc
from gapwright.operators import spatial as sp
from gapwright.operators import windows as wn
from gapwright.operators.learners import TreeImputer, knn_impute
from gapwright.functions.ordered import with_chunk
from gapwright.plans import empirical as em
from gapwright.plans.evaluation import evaluate, evaluate_stats
from gapwright.operators.metrics import sufficient_stats
from gapwright.sources import files
from gapwright.sources import tables as tb


@pytest.fixture(scope="module")
def samples(spark, sf):
    return tb.well_samples(spark, sf, chunk=128).persist()


@pytest.fixture(scope="module")
def ws(samples):
    return wn.window_samples(samples).persist()


def test_mask_shapes(ws):
    for r in mk.mask_summary(mk.apply_masks(ws)).collect():
        n = [r.n_gr, r.n_rhob, r.n_nphi]
        live = [v for v in n if v]
        if r.scenario == "blackout":
            assert len(set(live)) == 1 and live[0] == r.t_max - r.t_min + 1 and 76 <= live[0] <= 231
        else:
            assert len(live) == 1
            assert {"single": 1 <= live[0] <= 5, "block": live[0] in (20, 100), "profile": live[0] == 256}[r.scenario]
    part = mk.mask_summary(mk.apply_masks(ws, ["blackout"], allow_full=False)).collect()
    assert all(min(r.n_gr, r.n_rhob, r.n_nphi) == 0 for r in part)


def test_unknown_scenario_raises(ws):
    with pytest.raises(ValueError):
        mk.apply_masks(ws, ["not_a_scenario"])


def test_seed_table():
    assert [eval_seed(s) for s in (*SCENARIOS, "blackout_emp")] == [1000, 1001, 1002, 1003, 1004]
    assert eval_seed("block", 3) == 301001


def test_loo_subtraction_equals_refit(samples, ws):
    pdf = ws.toPandas()
    for r in sc.fold_scaler(samples).collect():
        t = pdf[pdf.well != r.well]
        for c in ("gr", "rhob", "nphi"):
            assert r[f"mu_{c}"] == pytest.approx(t[c].mean(), rel=1e-9)
            assert r[f"sd_{c}"] == pytest.approx(t[c].std(ddof=0) + 1e-8, rel=1e-9)


def test_linear_weights(samples, ws):
    pdf = ws.toPandas()
    fits = sc.fold_fits(sc.fold_moments(samples), ("ridge", "mice")).limit(3).collect()
    for r in fits:
        t = pdf[pdf.well != r.well][["gr", "rhob", "nphi"]]
        z = ((t - t.mean()) / (t.std(ddof=0) + 1e-8)).to_numpy()
        x, y = z[:, [1, 2]], z[:, 0]
        w = np.linalg.solve(x.T @ x + np.eye(2), x.T @ y)
        assert [r.w_gr_rhob, r.w_gr_nphi] == pytest.approx(list(w), rel=1e-7, abs=1e-10)
        # evidence iteration on the full data
        n, alpha, lam, old = len(y), 1 / (y.var() + 2.2e-16), 1.0, None
        eig = np.linalg.eigvalsh(x.T @ x)
        for i in range(300):
            b = np.linalg.solve(x.T @ x + lam / alpha * np.eye(2), x.T @ y)
            gamma = (alpha * eig / (lam + alpha * eig)).sum()
            lam = (gamma + 2e-6) / (b @ b + 2e-6)
            alpha = (n - gamma + 2e-6) / (((y - x @ b) ** 2).sum() + 2e-6)
            if i and np.abs(old - b).sum() < 1e-3:
                break
            old = b
        b = np.linalg.solve(x.T @ x + lam / alpha * np.eye(2), x.T @ y)
        assert [r.b_gr_rhob, r.b_gr_nphi] == pytest.approx(list(b), rel=1e-5, abs=1e-9)


def _pchip(t, y, q):
    """Plain reference of the shape-preserving cubic."""
    h, m = np.diff(t), np.diff(y) / np.diff(t)
    d = np.zeros(len(t))
    for k in range(1, len(t) - 1):
        if m[k - 1] * m[k] > 0:
            a, b = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            d[k] = (a + b) / (a / m[k - 1] + b / m[k])

    def end(h0, h1, m0, m1):
        v = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        if np.sign(v) != np.sign(m0):
            return 0.0
        return 3 * m0 if np.sign(m0) != np.sign(m1) and abs(v) > 3 * abs(m0) else v
    d[0], d[-1] = end(h[0], h[1], m[0], m[1]), end(h[-1], h[-2], m[-1], m[-2])
    k = np.clip(np.searchsorted(t, q) - 1, 0, len(h) - 1)
    s = (q - t[k]) / h[k]
    return ((1 + 2 * s) * (1 - s) ** 2 * y[k] + s * (1 - s) ** 2 * h[k] * d[k]
            + s ** 2 * (3 - 2 * s) * y[k + 1] + s ** 2 * (s - 1) * h[k] * d[k + 1])


def test_sequence_imputers(samples, ws):
    masked = mk.apply_masks(ws, ["single", "block", "blackout"]).persist()
    fits = sc.fold_scaler(samples)
    pred = im.predict(masked, fits, ["locf", "interp_linear", "interp_pchip"]).toPandas()
    full = masked.toPandas().sort_values("t")
    mu = fits.toPandas().set_index("well")
    n = 0
    for key, g in full.groupby(["scenario", "well", "start"]):
        p = pred[(pred.scenario == key[0]) & (pred.well == key[1]) & (pred.start == key[2])].sort_values("t")
        for i, c in enumerate(("gr", "rhob", "nphi")):
            q = p[(p.mask_bits & (1 << i)) > 0]
            x = g[f"x_{c}"].to_numpy(float)
            o = np.flatnonzero(np.isfinite(x))
            if not len(q) or not len(o):
                continue
            t = q["t"].to_numpy()
            np.testing.assert_allclose(q[f"p_interp_linear_{c}"], np.interp(t, o, x[o]), rtol=1e-9)
            want = [x[o[o < v][-1]] if (o < v).any() else mu.loc[key[1], f"mu_{c}"] for v in t]
            np.testing.assert_allclose(q[f"p_locf_{c}"], want, rtol=1e-9)
            cubic = np.where((t > o[0]) & (t < o[-1]), _pchip(o.astype(float), x[o], t.astype(float)), np.interp(t, o, x[o]))
            np.testing.assert_allclose(q[f"p_interp_pchip_{c}"], cubic, rtol=1e-7, atol=1e-9)
            n += len(q)
    assert n > 3000


def test_wide_statistics_equal_points(samples):
    key = ["method", "mask_seed", "scenario", "log", "well"]
    a = evaluate_stats(samples, ["mean", "ridge"], ["block"]).toPandas().sort_values(key)
    b = sufficient_stats(evaluate(samples, ["mean", "ridge"], ["block"])).toPandas().sort_values(key)
    for c in ("n", "sum_y", "sum_y2", "sse", "sae"):
        np.testing.assert_allclose(a[c], b[c], rtol=1e-9)


def test_user_model_adapter(samples, ws):
    class Zero:
        def impute(self, z):
            return np.nan_to_num(z, nan=0.0)

    masked = mk.apply_masks(ws, ["profile"])
    fits = sc.fold_scaler(samples)
    got = im.PandasImputer(Zero(), 256, "zero").transform(masked, fits)
    both = got.join(im.predict(masked, fits, ["mean"]), ["scenario", "mask_seed", "well", "start", "t"])
    bad = both.where("(mask_bits & 1) > 0 AND abs(p_zero_gr - p_mean_gr) > 1e-9")
    assert both.count() > 0 and bad.count() == 0


def test_identifiers(spark):
    raw = ["SYN01", "SOME-WELL-1-14-9999-", "some_well-2", "SOME-WELL-3D", "A-SS-B-1"]
    df = spark.createDataFrame([(r,) for r in raw], "n string").select(sp.normalise_id(F.col("n")).alias("k"))
    assert [r.k for r in df.collect()] == ["SYN01", "SOME-WELL-1", "SOME-WELL-2", "SOME-WELL-3", "A-SOUS-B-1"]


def test_anonymise_is_strict(spark):
    m = spark.createDataFrame([("A-1", "W01")], "well_name string, anon_id string")
    ok = files.anonymise(spark.createDataFrame([("A-1-14-77",)], "well string"), m)
    assert ok.first().well == "W01"
    with pytest.raises(Exception, match="anonymisation map"):
        files.anonymise(spark.createDataFrame([("B",)], "well string"), m).collect()


def _spatial_case(spark):
    rng = np.random.default_rng(2)
    co = [(w, float(x), float(y)) for w, (x, y) in enumerate(rng.uniform(0, 20000, (9, 2)))]
    grid = [(w, g, *[None if rng.random() < 0.2 else float(rng.normal()) for _ in range(3)]) for w in range(9) for g in range(6)]
    return (spark.createDataFrame(co, "well long, x double, y double"), np.array(co)[:, 1:] / 1000,
            spark.createDataFrame(grid, "well long, g long, gr double, rhob double, nphi double"),
            {(w, g): np.array([np.nan if v is None else v for v in vs]) for w, g, *vs in grid})


def test_same_depth_and_kriging(spark):
    co, xy, grid, val = _spatial_case(spark)
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    idw = {(r.well, r.g): r.p_gr for r in sp.same_depth(grid, grid, co).collect()}
    nn = {(r.well, r.g): r.p_gr for r in sp.same_depth(grid, grid, co, "nnwell").collect()}
    ranges = spark.createDataFrame([(w, lg, 4.0) for w in range(9) for lg in ("GR", "RHOB", "NPHI")], "well long, log string, range_km double")
    ok = {(r.well, r.g): r.p_gr for r in sp.kriging(grid, grid, co, ranges).collect()}
    for (w, g) in val:
        o = [v for v in range(9) if v != w and np.isfinite(val[v, g][0])]
        y, dist = np.array([val[v, g][0] for v in o]), d[w, o]
        wt = 1 / dist ** 2
        assert idw[w, g] == pytest.approx(wt @ y / wt.sum()) and nn[w, g] == pytest.approx(y[np.argmin(dist)])
        n = len(o)
        k = np.ones((n + 1, n + 1))
        k[:n, :n] = 1 - np.exp(-d[np.ix_(o, o)] / 4.0)
        k[n, n] = 0
        lam = np.linalg.solve(k, np.r_[1 - np.exp(-dist / 4.0), 1.0])[:n]
        assert ok[w, g] == pytest.approx(lam @ y, rel=1e-6)


@pytest.mark.parametrize("kind", ["idw", "nnwell"])
def test_spatial_points_leave_the_task_that_estimates_them(spark, monkeypatch, kind):
    """several target and source blocks and layers against brute force; no estimate is shuffled."""
    co, xy, grid, val = _spatial_case(spark)
    for name, size in (("SOURCE_BLOCK", 2), ("TARGET_BLOCK", 4), ("TARGET_ROWS", 3), ("LAYER", 2), ("POINT_ROWS", 5)):
        monkeypatch.setattr(sp, name, size)
    runs = [(w, s, k, b, [(a, e, a - 2, e + 1) for a, e in r], 10.0, 20.0, 30.0) for w in range(9)
            for s, k, b, r in ((0, "x", 3, [(0, 3)]), (2, "y", 5, [(1, 2), (3, 4)]))]
    specs = spark.createDataFrame(runs, "well long, start long, scenario string, mask_bits int, runs array<struct<a:int,b:int,before:int,after:int>>, "
                                  "mu_gr double, mu_rhob double, mu_nphi double")
    off = spark.createDataFrame([(w, 0) for w in range(9)], "well long, offset long")
    far = co.where("well <> 8")                            # no coordinates: nothing to read, and read by nobody
    hidden = grid.withColumn("hidden", F.expr("well = 1 AND g < 3"))
    for hide in (False, True):
        points = sp.spatial_points(specs, hidden, far, off, kind, ["scenario", "well", "start"], told=True, hide=hide)
        plan = points._jdf.queryExecution().sparkPlan().toString()
        assert "Exchange" not in plan.split("MapInArrow")[0]
        got = {(r.scenario, r.well, r.start, r.t, r.log): r for r in points.collect()}
        want = {}
        for w, s, k, b, r, *mu in runs:
            for g, t in ((s + t, t) for a, e, *_ in r for t in range(a, e)):
                for i, log in enumerate(("GR", "RHOB", "NPHI")):
                    if b & (1 << i):
                        seen = [v for v in range(8) if w < 8 and v != w and np.isfinite(val[v, g][i]) and not (hide and v == 1 and g < 3)]
                        d, y = np.hypot(*(xy[seen] - xy[w]).T), np.array([val[v, g][i] for v in seen])
                        want[k, w, s, t, log] = (mu[i] if not seen else d ** -2 @ y / (d ** -2).sum() if kind == "idw" else y[d.argmin()]), val[w, g][i]
        assert set(got) == set(want)
        for key, (pred, truth) in want.items():
            assert got[key].pred == pytest.approx(pred)
            assert key[1] == 8 or (got[key].truth is None if np.isnan(truth) else got[key].truth == truth)


@pytest.mark.parametrize("block", [4, None])
def test_pair_semivariances_are_never_shuffled(spark, block):
    """tiles of several blocks and depth layers against brute force; the finished pairs leave their task as rows."""
    co, xy, grid, val = _spatial_case(spark)
    pairs = sp.pair_semivariances(grid, co.unionByName(co.limit(3)), **({"block": block, "depth": 4} if block else {}))
    assert "Exchange" not in pairs._jdf.queryExecution().sparkPlan().toString().split("MapInArrow")[0]
    got = {(r.a, r.b, r.log): r for r in pairs.collect()}
    want = {}
    for k, log in enumerate(("GR", "RHOB", "NPHI")):
        for a in range(9):
            for b in range(a + 1, 9):
                sq = [(val[a, g][k] - val[b, g][k]) ** 2 for g in range(6) if np.isfinite(val[a, g][k]) and np.isfinite(val[b, g][k])]
                if sq:
                    want[a, b, log] = len(sq), np.mean(sq) / 2, np.hypot(*(xy[a] - xy[b]))
    assert set(got) == set(want)
    for key, (n, gamma, d) in want.items():
        assert got[key].n == n and got[key].gamma == pytest.approx(gamma) and got[key].d_km == pytest.approx(d)
    names = lambda df: df.withColumn("well", F.concat(F.lit("W"), "well"))
    text = {(int(r.a[1:]), int(r.b[1:]), r.log): r.n for r in sp.pair_semivariances(names(grid), names(co), block=4, depth=4).collect()}
    assert text == {k: v[0] for k, v in want.items()}


def test_pair_tiles_read_blocks_where_they_lie(spark):
    """no sample is sent to the tiles: they read checkpointed blocks; a well's layer may come in several rows."""
    co, _, grid, val = _spatial_case(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pairs = sp.pair_semivariances(grid, co, block=2, depth=4)
        assert "Exchange" not in pairs._jdf.queryExecution().sparkPlan().toString()
        got = {(r.a, r.b, r.log): r.n for r in pairs.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    both = {(a, b, log): sum(np.isfinite(val[a, g][k]) and np.isfinite(val[b, g][k]) for g in range(6))
            for k, log in enumerate(("GR", "RHOB", "NPHI")) for a in range(9) for b in range(a + 1, 9)}
    assert got == {k: n for k, n in both.items() if n}


def test_variogram_leaves_the_fold_out(spark):
    co, xy, grid, val = _spatial_case(spark)
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    pairs = sp.pair_semivariances(grid, co)
    scale = spark.createDataFrame([(1.0,)], "scale_km double")
    got = {(r.well, r.log): r for r in sp.variogram_fits(pairs, scale).collect()}
    for w in range(9):
        h, gm = [], []
        for i in range(9):
            for j in range(i + 1, 9):
                both = [(val[i, g][0], val[j, g][0]) for g in range(6) if np.isfinite(val[i, g][0]) and np.isfinite(val[j, g][0])]
                if w in (i, j) or not both:
                    continue
                h.append(d[i, j])
                gm.append(np.mean([(a - b) ** 2 / 2 for a, b in both]))
        h, gm = np.array(h), np.array(gm)
        best = min(((np.sum((gm - s * f) ** 2), r, s) for r in np.geomspace(max(h.min(), 0.5), h.max() * 3, 60)
                    for f in [1 - np.exp(-h / r)] for s in [f @ gm / (f @ f)]), key=lambda v: v[0])
        assert got[w, "GR"].range_km == pytest.approx(best[1]) and got[w, "GR"].sill == pytest.approx(best[2])


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    n = 400
    za, zb = np.round(rng.normal(size=n), 1), np.round(rng.normal(size=n), 1)      # many equal points
    well, y = rng.choice(4, n, p=[0.7, 0.1, 0.1, 0.1]), rng.normal(size=n)
    rows = [(int(w), i, 0, float(a), float(b), float(v)) for i, (w, a, b, v) in enumerate(zip(well, za, zb, y))]
    train = spark.createDataFrame(rows, "well int, start int, t int, za double, zb double, y double")
    qs = [(i, int(rng.integers(0, 4)), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    qs += [(100 + i, int(well[i]), float(za[i]), float(zb[i])) for i in range(20)]
    got = {r.qid: r.pred for r in knn_impute(spark.createDataFrame(qs, "qid int, well int, za double, zb double"), train, "y").collect()}
    for q, w, a, b in qs:
        keep = np.flatnonzero(well != w)
        dist = np.hypot(za[keep] - a, zb[keep] - b)
        o = np.lexsort((keep, well[keep], dist))[:10]
        dd, vv = dist[o], y[keep][o]
        want = vv[dd == 0].mean() if (dd == 0).any() else (vv / dd).sum() / (1 / dd).sum()
        assert got[q] == pytest.approx(want)


def test_tree_imputers_run(spark, ws):
    masked = mk.apply_masks(ws, ["block"])
    held = ws.agg(F.min("well")).first()[0]
    train = masked.where(F.col("well") != held).limit(800)
    one = train.agg(*[v for c in ("gr", "rhob", "nphi") for v in (F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}"))])
    for kind, over in (("rf", {"numTrees": 3, "maxDepth": 4}), ("xgb_miss", {"maxIter": 2, "maxDepth": 2}), ("xgb_chain_desc", {"maxIter": 2, "maxDepth": 2})):
        out = TreeImputer(kind, **over).fit(train, one).predict(masked.where(F.col("well") == held), one)
        assert out.where(f"p_{kind}_gr IS NULL OR p_{kind}_rhob IS NULL").count() == 0 and out.count() > 0


def test_ridge_reads_its_own_predictions(spark):
    """GR is predicted first; RHOB and NPHI of the same row see that prediction, channels not reached yet count as 0."""
    names = ["gr", "rhob", "nphi"]
    w = {("gr", "rhob"): 0.5, ("gr", "nphi"): 0.25, ("rhob", "gr"): 2.0, ("rhob", "nphi"): 1.0, ("nphi", "gr"): -1.0, ("nphi", "rhob"): 4.0}
    fits = spark.createDataFrame([("A", *[0.0] * 3, *[1.0] * 3, *w.values())],
                                 ["well", *[f"mu_{c}" for c in names], *[f"sd_{c}" for c in names], *[f"w_{a}_{b}" for a, b in w]])
    schema = "well string, start int, t int, gr double, rhob double, nphi double, mask_bits int, x_gr double, x_rhob double, x_nphi double"
    rows = spark.createDataFrame([("A", 0, 0, 9.0, 9.0, 8.0, 3, None, None, 8.0), ("A", 0, 1, 9.0, 9.0, 9.0, 7, None, None, None),
                                  ("A", 0, 2, 9.0, 4.0, 9.0, 5, None, 4.0, None)], schema)
    got = {r.t: r for r in im.predict(rows, fits, ["ridge"]).collect()}
    assert (got[0].p_ridge_gr, got[0].p_ridge_rhob) == (2.0, 12.0)          # 0.25 * 8; 2 * 2 + 8
    assert (got[1].p_ridge_gr, got[1].p_ridge_rhob, got[1].p_ridge_nphi) == (0.0, 0.0, 0.0)
    assert (got[2].p_ridge_gr, got[2].p_ridge_nphi) == (2.0, 14.0)          # 0.5 * 4; -2 + 4 * 4


def test_whole_queries_take_everything(spark, sf):
    from gapwright.plans.catalogue import QUERIES
    main = QUERIES["whole_main_table"](spark, sf).collect()
    assert {(r.method, r.scenario) for r in main} == {(m, s) for m in im.NATIVE for s in SCENARIOS} and {r.n_seeds for r in main} == {5}
    stats = QUERIES["whole_suff_stats"](spark, sf)
    assert {r.mask_seed for r in stats.select("mask_seed").distinct().collect()} == set(range(5))
    folds = stats.select("well").distinct().count()
    assert QUERIES["whole_fold_spread"](spark, sf).agg(F.max("n_folds")).first()[0] == 5 * folds
    assert {r.method for r in QUERIES["whole_empirical_blackout"](spark, sf).collect()} == set(im.NATIVE)
    pairs = QUERIES["whole_hexbin"](spark, sf)
    assert pairs.select("log_x", "log_y").distinct().count() == 3
    one = QUERIES["hexbin"](spark, sf)
    same = pairs.where("log_x = 'GR' and log_y = 'RHOB'").select(*one.columns)
    assert same.exceptAll(one).count() == one.exceptAll(same).count() == 0
    for k in ("whole_idw", "whole_nnwell", "impute_okrige"):
        assert {r.scenario for r in QUERIES[k](spark, sf).select("scenario").distinct().collect()} == set(SCENARIOS)


@pytest.mark.parametrize("size", [256, 64])
def test_runs_give_the_predictions_of_rows(samples, size):
    """Masks as runs over window arrays against masks as rows with ordered scans, for every method and scenario."""
    from gapwright.plans.evaluation import predictions
    methods = list(im.NATIVE)
    new = predictions(samples, methods, mask_seeds=(0, 3), size=size, stride=size // 4)
    masked = mk.apply_masks(wn.window_samples(samples, size, size // 4), mask_seeds=(0, 3), size=size)
    fits = sc.fold_fits(sc.fold_moments(samples, size, size // 4), tuple(methods))
    old = im.predict(masked, fits, methods)
    keys = ["scenario", "mask_seed", "well", "start", "t"]
    preds = [c for c in old.columns if c.startswith("p_")]
    assert sorted(new.columns) == sorted(old.columns)
    a, b = (d.select(*keys, "mask_bits", "gr", *preds).toPandas().sort_values(keys).reset_index(drop=True) for d in (new, old))
    assert len(a) == len(b) > 1000 and (a[[*keys, "mask_bits", "gr"]] == b[[*keys, "mask_bits", "gr"]]).all().all()
    for i, c in enumerate(("gr", "rhob", "nphi")):
        hit = (a.mask_bits.to_numpy() >> i & 1) > 0
        for p in (p for p in preds if p.endswith(f"_{c}")):
            np.testing.assert_allclose(a[p][hit], b[p][hit], rtol=1e-9, atol=1e-9, err_msg=p)


def test_adjacent_single_points_become_one_run(samples):
    """Short windows make neighbouring and equal draws common; runs never touch and knots beyond skip masked points."""
    w = wn.window_samples(samples, 8, 4).select("well", "start").distinct()
    for r in mk.mask_specs(w, ["single"], range(3), size=8, n_points=5).collect():
        hit = {t for x in r.runs for t in range(x.a, x.b)}
        assert all(x.b < y.a for x, y in zip(r.runs, r.runs[1:]))
        for x in r.runs:
            assert x.before == max([t for t in range(-9, x.a - 1) if t not in hit]) and x.after == min([t for t in range(x.b + 1, 20) if t not in hit])


@pytest.mark.parametrize("chunk", [5, 64])
def test_whole_well_cubic_crosses_chunks(spark, chunk):
    """Gaps at both ends, gaps over chunk borders, a log with two samples and one without any."""
    rng = np.random.default_rng(11)
    n = 200
    v = np.cumsum(rng.normal(size=(2, n, 3)), axis=1)
    for w in range(2):
        for a, b, c in ((0, 7, 0), (20, 60, 0), (61, 62, 0), (190, 200, 0), (3, 9, 1), (100, 131, 1), (0, 50, 2), (51, 180, 2), (181, 200, 2)):
            v[w, a:b, c] = np.nan
    v[1, :, 1] = np.nan
    rows = [(str(w), i, *[None if np.isnan(x) else float(x) for x in v[w, i]]) for w in range(2) for i in range(n)]
    s = with_chunk(spark.createDataFrame(rows, "well string, idx bigint, gr double, rhob double, nphi double"), size=chunk)
    fits = spark.createDataFrame([("0", 1.0, 2.0, 3.0), ("1", 1.0, 2.0, 3.0)], "well string, mu_gr double, mu_rhob double, mu_nphi double")
    got = em.fill_well(s, "interp_pchip", fits).toPandas()
    t = np.arange(n, dtype=float)
    for w in range(2):
        g = got[got.well == str(w)].sort_values("idx")
        for k, c in enumerate(("gr", "rhob", "nphi")):
            x = v[w, :, k]
            o = np.flatnonzero(~np.isnan(x))
            want = np.full(n, 2.0) if not len(o) else np.interp(t, o, x[o])
            if len(o) > 2:
                inside = (t > o[0]) & (t < o[-1])
                want = np.where(inside, _pchip(o.astype(float), x[o], t), want)
            np.testing.assert_allclose(g[c], np.where(np.isnan(x), want, x), rtol=1e-7, atol=1e-9)


def test_neighbour_availability_counts_words_of_depths(spark):
    rng = np.random.default_rng(3)
    n, size = 6, 256
    co, _, _, _ = _spatial_case(spark)
    val = rng.random((n, 700, 3))
    val[rng.random(val.shape) < 0.4] = np.nan
    val[2, :, 1] = np.nan
    rows = [(w, g, *[None if np.isnan(v) else float(v) for v in val[w, g]]) for w in range(n) for g in range(30 * w, 700 - 40 * w)]
    grid = spark.createDataFrame(rows, "well long, g long, gr double, rhob double, nphi double")
    offsets = spark.createDataFrame([(w, 30 * w, 0, 0) for w in range(n)], "well long, offset long, length long, d_tot long")
    wins = [(0, 0), (0, 64), (0, 320), (1, 128), (5, 192)]
    edges = sp.knn_edges(co.where(f"well < {n}"), 3)
    weights = sp.adjacency(edges, spark.createDataFrame([(2.0,)], "scale_km double"))
    df = sp.neighbour_availability(spark.createDataFrame(wins, "well long, start long"), edges, weights, grid, offsets, size)
    assert "sequence(0, 255" not in df._jdf.queryExecution().toString()     # no row per depth of a window
    got = {r.well: r for r in df.collect()}
    w8 = {(r.src, r.dst): r.weight for r in weights.collect()}
    near = {}
    for r in edges.collect():
        near.setdefault(r.src, []).append((r.d_km, r.dst))
    there = {(r[0], r[1], i): r[2 + i] is not None for r in rows for i in range(3)}
    for well in {w for w, _ in wins}:
        per = []
        for start in (s for w, s in wins if w == well):
            cell = [[(d, w8[well, v]) for d, v in near[well] if there.get((v, start + t + 30 * well, i))] for t in range(size) for i in range(3)]
            first = [min(c)[0] for c in cell if c]
            per.append((sum(map(len, cell)) / 768, np.mean(first) if first else np.nan, sum(b for c in cell for _, b in c) / 768))
        want = np.array(per)
        assert got[well].n_avail == pytest.approx(want[:, 0].mean()) and got[well].w_avail == pytest.approx(want[:, 2].mean())
        assert got[well].d_nearest_km == pytest.approx(np.nanmean(want[:, 1])) and got[well].k_neighbours == 3


def test_same_depth_blocks_and_searches_agree_with_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    xy, val = rng.random((700, 2)) * 30, rng.random((700, 4))
    val[rng.random(val.shape) < 0.5] = np.nan
    val[3:, 3] = np.nan                                   # measured in a few wells only
    val[:, 2] = np.nan                                    # nowhere
    own = np.arange(700)
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    num, den = sp._weighted_cells(xy, xy, own, val, rows=64, cols=100)
    near, dist = sp._nearest_cells(xy, xy, own, val, rows=32, first=8)
    for c in range(4):
        has = np.isfinite(val[:, c])
        w = np.maximum(d[:, has], 1e-3) ** -2.0
        assert np.allclose(num[:, c], w @ val[has, c]) and np.allclose(den[:, c], w.sum(axis=1))
        if has.any():
            j = d[:, has].argmin(axis=1)
            assert np.array_equal(near[:, c], np.where(np.isfinite(dist[:, c]), val[has, c][j], np.nan), equal_nan=True)
            assert np.array_equal(dist[:, c], d[:, has].min(axis=1))
        else:
            assert np.isinf(dist[:, c]).all()
    co, _, grid, _ = _spatial_case(spark)
    tiny = grid.join(co, "well").select(grid["*"])
    for kind in ("idw", "nnwell"):
        whole = sorted(map(tuple, sp.same_depth(tiny, tiny, co, kind).collect()))
        with monkeypatch.context() as m:
            m.setattr(sp, "SOURCE_BLOCK", 4)
            m.setattr(sp, "LAYER", 2)
            cut = sorted(map(tuple, sp.same_depth(tiny, tiny, co, kind).collect()))
        assert [r[:2] for r in cut] == [r[:2] for r in whole]
        for a, b in zip(cut, whole):
            assert all(u == v or u == pytest.approx(v) for u, v in zip(a[2:], b[2:]))


@pytest.mark.parametrize("shape", [(20.0, 1.0), (1.0, 400.0), (1.0, 1.0), (5.0, 0.0)])
def test_median_distance_of_any_box(spark, shape):
    rng = np.random.default_rng(11)
    xy = rng.random((300, 2)) * shape * 1000.0
    xy[:5] = xy[5]                                        # equal places do not count
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    co = spark.createDataFrame([(w, float(x), float(y)) for w, (x, y) in enumerate(xy)], "well long, x double, y double")
    assert sp.median_distance(co).first().scale_km == pytest.approx(np.median(d[d > 0]) / 1000.0, rel=1e-12)


def test_long_strip_is_cut_into_square_cells(spark, monkeypatch):
    from gapwright.functions import ranks
    rng = np.random.default_rng(12)
    co = spark.createDataFrame([(w, float(a), float(b)) for w, (a, b) in enumerate(rng.random((500, 2)) * (10.0, 100_000.0))],
                               "well long, x double, y double")
    seen, plain = [], ranks.rank_table
    monkeypatch.setattr(ranks, "rank_table", lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
    sp.median_distance(co).collect()
    assert seen[0] < 1000                                 # of 249,500 ordered pairs


def test_knn_files_no_point_in_cells_it_never_searches(spark):
    from gapwright.functions.neighbours import knn
    pts = spark.createDataFrame([(i, float(i % 30), float(i // 30)) for i in range(900)], "p long, x double, y double")
    df = knn(pts, "p", "x", "y", 3, 1.0)
    assert "sequence(0, 24" not in df._jdf.queryExecution().toString()
    got = {r.src: [] for r in df.collect()}
    for r in df.collect():
        got[r.src].append((r.dist, r.dst))
    for s in (0, 31, 899, 450):
        want = sorted((float(np.hypot(s % 30 - v % 30, s // 30 - v // 30)), v) for v in range(900) if v != s)[:3]
        assert sorted(got[s]) == want
