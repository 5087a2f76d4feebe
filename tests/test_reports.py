"""Reports of alignment and quantification against numpy."""

import json

import numpy as np
import pytest

from lumentrace.operators import reports

PAIRS = "run string, ref_id long, run_id long, ref_mz double, run_mz double, ref_rt double, run_rt double, ref_im double, run_im double, active boolean"


def test_nearest_ranks(spark):
    rng = np.random.default_rng(0)
    values = {k: rng.integers(0, 20, n).astype(float) for k, n in (("a", 1), ("b", 2), ("c", 101), ("d", 1000))}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("b", float("nan"))]
    got = {r.k: r for r in reports.at_shares(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k, x in values.items():
        s = np.sort(x)
        assert got[k].n == len(s) and [got[k][p] for p in reports.SHARES] == [s[int(np.floor(p * (len(s) - 1) + 0.5))] for p in reports.SHARES.values()]


def test_alignment_report(spark):
    rng = np.random.default_rng(1)
    rows = []
    for run, n in (("a", 700), ("b", 30)):
        for i in range(n):
            x, ppm = float(rng.uniform()), float(rng.normal(3.0, 1.0))
            im = 1.0 if i % 3 else 0.0
            rows.append((run, i, i + 5, 500.0, 500.0 * (1 + ppm * 1e-6), x, x - 0.02 + float(rng.normal(0, 0.001)), im, 1.01, bool(i % 5)))
    places = spark.createDataFrame([(r, 0.0, 10.0, 1.0, 11.0, [0.0, 1.0], [0.02, 0.02], 0.0, 3.0, 0.0, 0.01, False) for r in "ab"], "run string, low double, high double, ref_low double, ref_high double, knot_x array<double>, knot_y array<double>, mz_slope double, mz_intercept double, im_slope double, im_intercept double, is_reference boolean")
    pairs = spark.createDataFrame(rows, PAIRS)
    report = reports.alignment_report(pairs, places)
    got = {r.run: r for r in report.collect()}
    for run in "ab":
        mine = [r for r in rows if r[0] == run]
        after = np.array([(r[4] - r[3]) / r[3] * 1e6 - 3.0 for r in mine])
        s = got[run].stats["ppm_after"]
        assert (got[run].n_anchors, got[run].n_active, s.n) == (len(mine), sum(r[-1] for r in mine), len(mine))
        assert s.median == pytest.approx(np.median(after)) and s.std == pytest.approx(after.std(ddof=1)) and s.mad == pytest.approx(np.median(abs(after - np.median(after))))
        assert got[run].stats["im_after"].n == sum(r[7] != 0 for r in mine) and abs(got[run].stats["im_after"].median) < 1e-9 and abs(got[run].stats["rt_after"].median) < 1e-3
        assert len(got[run].anchors) == min(len(mine), reports.SHOWN)
    again = {r.run: r for r in reports.alignment_report(pairs.orderBy("run_mz"), places).collect()}
    assert [a.ref_id for a in again["a"].anchors] == [a.ref_id for a in got["a"].anchors]
    assert json.loads(report.where("run = 'b'").select(reports.as_json(report).alias("j")).first().j)["n_anchors"] == 30


def test_quantification_report(spark):
    cells = [("a", False, 1.0, 0.01), ("a", False, 2.0, 0.2), ("a", False, 0.0, 1.0), ("a", True, 5.0, 1.0), ("b", False, 0.0, 1.0)]
    got = {r.run: r for r in reports.quantification_report(spark.createDataFrame(cells, "run string, decoy boolean, intensity double, q double")).collect()}
    assert (got["a"].n_cells, got["a"].n_detected, got["a"].p25, got["a"].p95) == (3, 2, 0.01, 0.2) and got["a"].detection_rate == pytest.approx(2 / 3)
    assert (got["b"].n_detected, got["b"].p50) == (0, None)
