import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.operators import alignment as al
from lumentrace.operators import consensus as con
from lumentrace.operators import isotopes as iso

FEATURES = "run string, feature_id long, mz double, charge int, rt double, im double, score double"
ROWS = "run string, feature_id long, charge int, mass double, rt double, im double, score double"


def test_warp_finds_true_pairs_among_strangers():
    rng = np.random.default_rng(1)
    x = np.r_[rng.uniform(0, 1, 200), rng.uniform(0, 1, 100)]
    y = np.r_[x[:200] + 0.02 + rng.normal(0, 0.001, 200), rng.uniform(0, 1, 100)]
    kx, ky, active = al.fit_warp(x, y, al.Warping(threshold=0.01))
    assert active[:200].mean() > 0.9 and active[200:].mean() < 0.15 and np.interp(0.5, kx, ky) == pytest.approx(0.02, abs=0.003)
    assert (np.diff(kx + ky) >= -1e-12).all()
    assert al.fit_warp(x[:5], y[:5], al.Warping())[2].sum() == 0
    centres = [(0.10, 0.10), (0.25, 0.30), (0.40, 0.65), (0.55, 0.25), (0.70, 0.30), (0.85, 0.90)]
    pairs = np.array([(a + d, b + d) for a, b in centres for d in (-0.003, -0.001, 0.001, 0.003)])
    kx, ky = al.knots(pairs[:, 0], pairs[:, 1], 0.1)
    assert (np.diff(kx + ky) >= -1e-12).all() and kx[0] == 0 and kx[-1] == 1


def test_anchors_warp_and_places(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(80):
        mz, rt = 400.0 + 7 * i, float(rng.uniform(5, 95))
        rows += [("a", i, mz, 2, rt, 0.0, 0.9), ("b", i, mz * (1 + 3e-6), 2, rt + 2.0, 0.0, 0.9)]
    rows += [("a", 900, 300.0, 1, 0.0, 0.0, 0.9), ("a", 901, 301.0, 1, 100.0, 0.0, 0.9), ("b", 900, 390.0, 1, 0.0, 0.0, 0.9), ("b", 901, 391.0, 1, 100.0, 0.0, 0.9)]
    # A second run feature as near by m/z: the reference's next row must not lose its own to the first.
    rows += [("b", 500, 400.0 * (1 + 1e-6), 2, rows[0][4] + 2.0, 0.0, 0.9), ("b", 501, 400.0, 0, rows[0][4], 0.0, 0.9), ("b", 502, 400.0, 2, rows[0][4], 0.0, 0.1)]
    frame = spark.createDataFrame(rows, FEATURES)
    o = al.Warping(threshold=0.01)
    pairs = al.anchors(al.anchor_candidates(frame, "a", o))
    got = {(r.ref_id, r.run_id) for r in pairs.collect()}
    assert (0, 500) in got and {(i, i) for i in range(1, 80)} <= got and len(got) == 80
    lines, marked = al.warps(pairs, o)
    assert lines.first()["n_inliers"] == 80 and marked.where("active").count() == 80
    out = al.aligned(frame, "a", lines, spark.createDataFrame([("b", 0.0, -3.0)], "run string, slope double, intercept double"))
    off = out.alias("x").join(frame.where("run = 'a'").alias("y"), "feature_id").where("x.run = 'b' and feature_id between 1 and 79").agg(F.max(F.abs(F.col("x.ref_rt") - F.col("y.rt"))), F.max(F.abs(F.col("x.ref_mz") / F.col("y.mz") - 1))).first()
    assert off[0] < 0.3 and off[1] < 1e-9
    r = al.residuals(marked, lines).agg(F.max(F.abs("residual")), F.avg("ppm")).first()
    assert r[0] < 0.01 and r[1] == pytest.approx(-3, abs=0.1)
    with pytest.raises(Exception, match="mobility"):
        al.mobility_scale(spark.createDataFrame([("a", 0, 1.0, 1, 1.0, 0.9, 1.0), ("b", 0, 1.0, 1, 1.0, 400.0, 1.0)], FEATURES)).collect()


def test_spans_are_bounded(spark):
    chain = [("abc"[k], k, 2, 1000.0 * (1 + k * 6e-6), 10.0 + 0.6 * k, 0.0, 0.9 - 0.1 * k) for k in range(3)]
    bridge = [("a", 10, 2, 2000.0, 10.0, 1.0, 0.9), ("b", 11, 2, 2000.0, 10.0, 0.0, 0.8), ("c", 12, 2, 2000.0, 10.0, 1.2, 0.7)]
    isotope = [("a", 20, 2, 3000.0, 10.0, 0.0, 0.9), ("b", 21, 2, 3001.003, 10.0, 0.0, 0.9)]
    found = {r.feature_id: r.group_id for r in con.clusters(spark.createDataFrame(chain + bridge + isotope, ROWS)).collect()}
    assert found[0] == found[1] == "a:0" and found[2] == "c:2"
    assert found[10] == found[11] == "a:10" and found[12] == "c:12"
    assert found[20] != found[21]


def test_replicated_weak_groups_pass_and_lone_ones_do_not(spark):
    rows = [(f"r{k}", i, 2, 800.0 + i, 10 + 0.7 * i + 0.01 * k, 0.0, 0.3) for i in range(100) for k in range(4)] + [("r0", 999, 2, 5000.0, 50.0, 0.0, 0.99)]
    found = con.confident(spark.createDataFrame(rows, ROWS), con.Grouping(rt=0.5, cohorts=4)).collect()
    passed = [r for r in found if r.q <= 0.05]
    assert len(passed) == 100 and all(r.n_runs == 4 for r in passed)
    assert next(r for r in found if r.mass == 5000.0).q == 1
    four = next(r for r in found if r.mass == 800.0)
    pair = lambda d: 0.3 * np.exp(-2 * (0.01 * d / 0.5) ** 2)
    assert four.group_score == pytest.approx((3 * pair(1) + 2 * pair(2) + pair(3)) / 3)


def test_permutation_keeps_the_margins(spark):
    rows = [(f"r{k}", i, 2, 800.0 + i, float(i), 0.0, (i % 10) / 10) for i in range(60) for k in range(2)]
    frame = spark.createDataFrame(rows, ROWS)
    out = con.permuted(frame, 3)
    sums = out.groupBy("cohort", "run").agg(F.count("*").alias("n"), F.sum("rt").alias("rt"), F.sum("mass").alias("m")).collect()
    assert {(r.n, r.rt, r.m) for r in sums} == {(60, 1770.0, 60 * 800.0 + 1770)} and len(sums) == 6
    assert out.where("rt != mass - 800").count() > 200
    assert sorted(r.rt for r in con.shifted(frame).where("run = 'r0'").collect()) == [float(i) for i in range(60)]
    mass = con.projected(spark.createDataFrame([("a", 1, 500.0, 2, 1.0, 0.0, 0.5, 1.0, 500.0), ("a", 2, 500.0, 0, 1.0, 0.0, 0.5, 1.0, 500.0), ("a", 3, 1.0, 2, float("nan"), 0.0, 0.5, float("nan"), 1.0)], FEATURES + ", ref_rt double, ref_mz double")).collect()
    assert [r.mass for r in mass] == [pytest.approx(1000.0 - 2 * iso.PROTON)]
