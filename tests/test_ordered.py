"""Two-level ordered primitives against brute force, with chunks small enough to be crossed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapwright.functions.neighbours import knn
from gapwright.functions.ordered import carry, carry_two, ordinal, with_chunk
from gapwright.functions.ranks import average_rank, exact_percentiles
from gapwright.operators import missingness as ms
from gapwright.operators.cleaning import depth_qc


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    rows = []
    for w, n in (("A", 700), ("B", 37), ("C", 1)):
        gone = np.zeros((n, 3), bool)
        for _ in range(n // 25):
            a = rng.integers(0, n)
            gone[a:a + rng.integers(1, 90), rng.integers(0, 3)] = True
        v = rng.normal(size=(n, 3))
        for i in range(n):
            rows.append((w, i, 100 + i * 0.1524, *[None if gone[i, c] else float(v[i, c]) for c in range(3)]))
    return pd.DataFrame(rows, columns=["well", "idx", "depth", "gr", "rhob", "nphi"]).astype({"gr": float, "rhob": float, "nphi": float})


def as_spark(spark, pdf, size):
    df = spark.createDataFrame(pdf)
    for c in ("gr", "rhob", "nphi"):
        df = df.withColumn(c, F.nanvl(c, F.lit(None).cast("double")))
    return with_chunk(df, size=size)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_carry_crosses_chunks(spark, frame, forward, strict):
    got = carry(as_spark(spark, frame, 16), ["well"], "idx", ["gr", "nphi"], forward, strict, "o_").toPandas()
    got = got.sort_values(["well", "idx"]).reset_index(drop=True)
    for c in ("gr", "nphi"):
        g = frame.groupby("well")[c]
        src = g.shift(1 if forward else -1) if strict else frame[c]
        want = src.groupby(frame["well"]).ffill() if forward else src.groupby(frame["well"]).bfill()
        np.testing.assert_allclose(got[f"o_{c}"].astype(float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_intervals_gaps_segments(spark, frame, size):
    runs = ms.code_runs(as_spark(spark, frame, size)).persist()
    code = frame[["gr", "rhob", "nphi"]].isna().to_numpy() @ np.array([1, 2, 4])
    want_iv, want_gap, want_seg = set(), set(), set()
    for w, idx in frame.groupby("well").groups.items():
        c = code[idx]
        L = len(c)

        def pieces(mask):
            e = np.flatnonzero(np.diff(np.r_[0, mask.astype(int), 0]))
            return zip(e[::2], e[1::2])
        cut = np.r_[0, np.flatnonzero(np.diff(c)) + 1, L]
        want_iv |= {(w, int(c[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:]) if c[a]}
        for k, lg in enumerate(("GR", "RHOB", "NPHI")):
            want_gap |= {(w, lg, int(a), int(b), bool(a == 0 or b == L)) for a, b in pieces((c >> k) & 1)}
        want_seg |= {(w, int(a), int(b)) for a, b in pieces(c == 0) if b - a >= 10}
    assert {(r.well, r.code, r.start, r.end) for r in ms.intervals(runs, size).collect()} == want_iv
    gaps = ms.gaps(runs, ms.well_lengths(as_spark(spark, frame, size)), size)
    assert {(r.well, r.log, r.start, r.end, r.is_edge) for r in gaps.collect()} == want_gap
    assert {(r.well, r.start, r.end) for r in ms.intact_segments(runs, 10, size).collect()} == want_seg
    runs.unpersist()


def test_ordinal_two_levels(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 500).alias("v"))
    got = ordinal(df.withColumn("slab", F.expr("v div 50")), ["g"], "slab", ["v"], "pos").toPandas()
    assert (got.sort_values(["g", "v"]).groupby("g").cumcount() == got.sort_values(["g", "v"])["pos"]).all()


def test_exact_percentiles_and_ranks(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.choice(list("aab"), 3000), "v": np.round(rng.lognormal(sigma=3, size=3000), 1)})
    df = spark.createDataFrame(pdf)
    got = exact_percentiles(df, ["g"], "v", {"p1": 0.01, "p50": 0.5, "p99": 0.99}).toPandas().set_index("g")
    for g, v in pdf.groupby("g")["v"]:
        np.testing.assert_allclose(got.loc[g, ["p1", "p50", "p99"]].astype(float), np.percentile(v, [1, 50, 99]))
    r = average_rank(df.withColumn("i", F.monotonically_increasing_id()), ["g"], "v", "r").toPandas()
    want = r.groupby("g")["v"].rank()
    np.testing.assert_allclose(r["r"], want)


def test_knn_matches_brute_force_with_a_hot_cluster(spark):
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal(0, 1, (150, 2)), rng.uniform(-5000, 5000, (80, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    got = knn(df, "id", "x", "y", 5, 0.05).toPandas().sort_values(["src", "rank"])
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    np.testing.assert_allclose(got["dist"].to_numpy().reshape(-1, 5), np.sort(d, 1)[:, :5])


def test_depth_qc_golden(spark):
    ok = 1000 + np.arange(500) * 0.1524
    bad = np.r_[1741 + np.arange(200) * 0.5, 1741 + 200 * 0.5 + 72.5 + np.arange(400) * 0.5]
    rep = ok[:100].copy()
    rep[50] = rep[49]
    rows = [(w, i, float(v)) for w, d in (("ok", ok), ("bad", bad), ("rep", rep), ("one", ok[:1])) for i, v in enumerate(d)]
    df = with_chunk(spark.createDataFrame(rows, "well string, idx long, depth double"), size=64)
    got = {r.well: r for r in depth_qc(df).collect()}
    assert got["ok"].status == "kept" and got["ok"].n_jumps == 0
    assert got["bad"].status == "EXCLUDED" and got["bad"].n_jumps == 1
    assert got["bad"].median_step_m == pytest.approx(0.5) and got["bad"].jump_m == pytest.approx(72.5, abs=0.6)
    assert got["rep"].status == "EXCLUDED" and got["one"].status == "EXCLUDED"


def test_missingness_golden_shares(spark):
    rows = []
    for i in range(400):
        gr = None if i in range(20, 25) or i in range(40, 45) or i in range(60, 65) else 1.0
        rn = None if 200 <= i < 300 else 1.0
        rows.append(("A", i, i * 0.1524, gr, rn, rn))
    df = with_chunk(spark.createDataFrame(rows, "well string, idx long, depth double, gr double, rhob double, nphi double"), size=32)
    s = {r.k: r for r in ms.cooccur_samples(df).collect()}
    assert (s[1].pct, s[2].pct) == (13.0, 87.0) and s[2].prob == pytest.approx(100 / 115)
    i = {r.k: r.pct for r in ms.cooccur_intervals(ms.intervals(ms.code_runs(df), 32)).collect()}
    assert (i[1], i[2], i[3]) == (75.0, 25.0, 0.0)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("size", [3, 16, 1000])
def test_two_deep_carry_crosses_chunks(spark, frame, forward, size):
    got = carry_two(as_spark(spark, frame, size), ["well"], "idx", ["gr", "nphi"], forward).toPandas()
    side = "b" if forward else "a"
    for w, part in got.groupby("well"):
        part = part.sort_values("idx")
        for c in ("gr", "nphi"):
            knots = [(int(i), v) for i, v in zip(part["idx"], part[c]) if not np.isnan(v)]
            for row in part.itertuples():
                seen = [k for k in knots if k[0] < row.idx][::-1] if forward else [k for k in knots if k[0] > row.idx]
                for name, want in ((side, seen[:1]), (side + "o", seen[1:2])):
                    t, y = getattr(row, f"{name}t_{c}"), getattr(row, f"{name}y_{c}")
                    assert (np.isnan(t) and np.isnan(y)) if not want else (t, y) == want[0]
