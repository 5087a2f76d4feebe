import numpy as np
import pytest

from lumentrace.operators import isotopes as iso
from lumentrace.operators import quantification as qu
from lumentrace.operators import targets as tg

HILLS = "run string, hill_id long, mz double, im double, rt_start double, rt_end double, scan_start int, scan_end int, intensity_sum double, profile array<double>"
CELLS = "cell_id long, group long, run string, decoy boolean, mz double, charge int, rt double, im double, template array<double>"


def test_cells_are_measured(spark):
    x = np.linspace(0, 1, 101)
    bell = np.exp(-0.5 * ((x - 0.5) / 0.02) ** 2) * (np.abs(x - 0.5) <= 0.06)
    keep = np.flatnonzero(bell > 0)
    hills = [("a", k, 500 + k * iso.NEUTRON / 2, 0.0, float(x[keep[0]]), float(x[keep[-1]]), int(keep[0]), int(keep[-1]), float(s * bell.sum()), (s * bell[keep]).tolist()) for k, s in enumerate([600.0, 300.0, 100.0])]
    cells = [(1, 1, "a", False, 500.0, 2, 0.5, 0.0, [0.6, 0.3, 0.1]), (1, 1, "a", True, 505.5, 2, 0.49, 0.0, [0.6, 0.3, 0.1])]
    found = {r.decoy: r for r in qu.quantified(spark.createDataFrame(cells, CELLS), spark.createDataFrame(hills, HILLS)).collect()}
    one, none = found[False], found[True]
    assert one.intensity == pytest.approx(1000 * bell.sum()) and one.pattern == pytest.approx(1) and one.coelution == pytest.approx(1) and one.apex == 12 and one.hybrid == pytest.approx(1)
    assert one.rt_apex == pytest.approx(0.5) and one.observed_mz == 500.0 and one.preceding == 0 and (none.intensity, none.apex, none.rt_apex) == (0.0, -1, None)
    assert {r.run: r["columns"] for r in qu.columns_for(spark.createDataFrame(hills, HILLS)).collect()} == {"a": 25}
    long = qu.details(spark.createDataFrame([(1, "a", False, 500.0, 500.001, 0.0, 0.0, 1.0, 1.5, 0.2), (1, "a", True, 500.0, None, 0.0, None, 1.0, None, None)], "group long, run string, decoy boolean, mz double, observed_mz double, im double, observed_im double, rt double, rt_apex double, q double")).collect()
    assert {r.q for r in long} == {0.2} and {r.mz_ppm and round(r.mz_ppm, 6) for r in long} == {2.0, None}


def test_q_by_class(spark):
    rows = [(i, float(i % 37), i % 3 == 0, "direct" if i < 200 else "transferred") for i in range(400)]
    found = qu.q_by_class(spark.createDataFrame(rows, "id long, score double, decoy boolean, evidence string"), ["direct", "transferred"])
    assert found.count() == 400 and found.where("decoy and q < 1").count() == 0


def test_matrices_have_defaults(spark):
    rows = spark.createDataFrame([(1, "a", False, 5.0, 0.01), (1, "a", True, 2.0, 1.0), (2, "b", False, 7.0, 0.2)], "group long, run string, decoy boolean, intensity double, q double")
    wide = qu.matrices(rows, ["a", "b"])
    assert {tuple(r) for r in wide["intensity"].collect()} == {(1, 5.0, 0.0), (2, 0.0, 7.0)}
    assert {tuple(r) for r in wide["q"].collect()} == {(1, 0.01, 1.0), (2, 1.0, 0.2)}
    assert {tuple(r) for r in qu.detections(rows).collect()} == {("a", 1, 1, 1), ("b", 1, 1, 0)}


IDS = "run string, peptide string, charge int, mass double, rt double, q double, im double, row long"


def test_targets(spark):
    rows = [("a", "P", 2, 1000.0, 5.0, 0.01, None, 0), ("a", "P", 2, 1000.0, 5.2, 0.001, None, 1), ("b", "P", 2, 1000.0, 6.0, 0.02, None, 2), ("a", "M", 2, 1000.0, 5.0, 0.01, None, 3), ("b", "M", 2, 1001.0, 5.0, 0.01, None, 4), ("a", "T", 3, 900.0, 1.0, 0.01, None, 5), ("a", "T", 3, 900.0, 9.0, 0.01, None, 6)]
    ids = spark.createDataFrame(rows, IDS)
    found = {r.peptide: r for r in tg.build(ids).collect()}
    assert found["P"].reason is None and found["P"].seed.row == 1 and found["P"].n_runs == 2
    assert (found["M"].reason, found["T"].reason) == ("inconsistent mass", "ambiguous time")
    observed = spark.createDataFrame([("a", 300.0, 600.0), ("b", 200.0, 260.0)], "run string, low double, high double")
    more = tg.expanded(tg.build(ids), observed)
    assert {(r.charge, r.inferred, tuple(r.eligible_runs)) for r in more.collect()} == {(2, False, ("a", "b")), (3, True, ("a",)), (4, True, ("b",))}
    runs, aligned = observed.select("run"), observed.where("run = 'a'").select("run")
    plan = {(r.charge, r.run): (r.direct, r.inferred, r.attempted) for r in tg.cell_plan(more, ids, runs, aligned).collect()}
    assert plan == {(2, "a"): (True, False, True), (2, "b"): (True, False, True), (3, "a"): (False, True, True), (3, "b"): (False, True, False), (4, "a"): (False, True, False), (4, "b"): (False, True, False)}
    cells = spark.createDataFrame([(True, True, False, 5.0, 0.01), (True, False, True, 5.0, 0.5), (True, False, False, 0.0, 1.0), (False, False, False, None, None)], "attempted boolean, direct boolean, inferred boolean, intensity double, q double")
    assert [(r.evidence, r.status) for r in tg.labelled(cells).collect()] == [("direct", "quantified"), ("inferred", "above q"), ("transferred", "no signal"), ("transferred", "not attempted")]


def test_times_need_a_majority(spark):
    rows = [("a", "P", 2, 1.0, t, 0.01, None, k) for k, t in enumerate([5.0, 5.1, 9.0])] + [("a", "Q", 2, 1.0, t, 0.01, None, 10 + k) for k, t in enumerate([1.0, 9.0])] + [("a", "R", 2, 1.0, 20.0, 0.01, None, 20)]
    ranges = spark.createDataFrame([("a", 0.0, 10.0)], "run string, low double, high double")
    kept = {r.row for r in tg.rt_supported(spark.createDataFrame(rows, IDS), ranges).where("supported").collect()}
    assert kept == {0, 1}
