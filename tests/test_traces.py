import pytest
from pyspark.sql import functions as F

from lumentrace.operators import statistics, traces
from lumentrace.plans import registry

from tests.conftest import DATA


def peaks(spark, rows):
    return spark.createDataFrame([(c, s, i, i * 10) for c, s, i in rows], "channel long, scan int, intensity long, mz_weighted long")


def test_gap_of_one_is_bridged_and_two_splits(spark):
    rows = [(1, s, 100) for s in (0, 1, 3, 6, 7, 8)]
    found = traces.traces(peaks(spark, rows)).orderBy("scan_start").collect()
    assert [(r.scan_start, r.scan_end, r.n_scans, r.skipped) for r in found] == [(0, 3, 3, 1), (6, 8, 3, 0)]


def test_gap_is_filled_with_the_line_between(spark):
    found = traces.filled(peaks(spark, [(1, 0, 100), (1, 2, 200)])).orderBy("scan").collect()
    assert [(r.scan, r.value, r.gap) for r in found] == [(0, 100.0, False), (1, 150.0, True), (2, 200.0, False)]


def test_shape_counts_steps_towards_the_apex(spark):
    rows = [(1, s, v) for s, v in enumerate([10, 80, 50, 100, 60, 30, 40, 5])]
    assert traces.shape(peaks(spark, rows)).first()["shape"] == round(5 / 7, 6)


def test_gaps_count_in_shapes_and_estimators(spark):
    gap = peaks(spark, [(1, 0, 10), (1, 1, 20), (1, 3, 30), (1, 4, 30), (1, 5, 5)])
    assert traces.shape(gap).first()["shape"] == round(4 / 5, 6)
    r = traces.estimators(gap).first()
    assert (r.scattered5, r.consecutive5) == (95, 90)
    assert r.parabolic == round(30 - 30 * 30 / (8 * (0 - 60 + 30)), 3)  # the first of the two greatest scans


def test_empty_table(spark):
    assert traces.traces(peaks(spark, [])).count() == 0


def test_q_values(spark):
    rows = spark.createDataFrame([(0, 1.0, False), (1, 0.9, True), (2, 0.8, False), (3, 0.7, False)], "id long, score double, decoy boolean")
    found = {r.id: r.q for r in statistics.target_decoy_q(rows).collect()}
    assert found == {0: 0.0, 1: 1.0, 2: pytest.approx(1 / 3), 3: pytest.approx(1 / 3)}
    tied = spark.range(400).select("id", F.lit(0.5).alias("score"), (F.col("id") % 2 == 1).alias("decoy"))
    assert {r.q for r in statistics.target_decoy_q(tied, True).where("not decoy").collect()} == {1.0}
    assert statistics.target_decoy_q(rows.where("not decoy")).agg(F.max("q")).first()[0] == 0


def test_a_run_twice_as_bright_has_factor_one(spark):
    rows = [(r, run, v * (2 if run == "b" else 1)) for r, v in enumerate([100.0, 250.0, 900.0]) for run in "abc"] + [(9, "a", 7.0), (9, "b", 0.0)]
    cells = spark.createDataFrame(rows, "row long, run string, intensity double")
    factors = statistics.median_ratio(cells)
    assert {r.run: round(r.factor, 9) for r in factors.collect()} == {"a": 0, "b": 1, "c": 0}
    even = statistics.normalised(cells, factors).where("row < 9").groupBy("row").agg(F.round(F.max("intensity") - F.min("intensity"), 6).alias("d"))
    assert {r.d for r in even.collect()} == {0}


def test_line_keeps_perfect_rows_and_drops_outliers_for_good(spark):
    rows = [("flat", float(x), 2.0 * x + 1) for x in range(50)] + [("odd", float(x), 3.0 * x + (x % 2) * 0.1 + (500 if x == 20 else 0)) for x in range(60)] + [("two", 0.0, 1.0), ("two", 1.0, 2.0)]
    lines = {r.run: r for r in statistics.clipped_line(spark.createDataFrame(rows, "run string, x double, value double")).collect()}
    assert (lines["flat"].n, lines["odd"].n, lines["two"].n) == (50, 59, 2)
    assert lines["odd"].slope == pytest.approx(3, abs=1e-3) and lines["flat"].intercept == pytest.approx(1)


def test_spread_bins_are_all_there_and_shrunk(spark):
    rows = spark.createDataFrame([("a", 0.0, -1.0), ("a", 0.01, 1.0), ("a", 1.0, 5.0), ("b", 0.5, 1.0)], "run string, x double, residual double")
    found = {(r.run, r.bin): r for r in statistics.spread_bins(rows).collect()}
    whole = 28 / 3
    assert set(found) == {("a", k) for k in range(12)}
    assert found["a", 0].sigma == pytest.approx(((2 * 2 + 20 * whole) / 22) ** 0.5) and found["a", 5].sigma == pytest.approx(whole**0.5)
    assert (found["a", 11].n, found["a", 5].n) == (1, 0)


def test_surface_recovers_offsets_and_falls_back(spark):
    flat = spark.range(1000).select((400 + F.col("id") % 800).cast("double").alias("mz"), (F.col("id") % 60).cast("double").alias("rt"), F.lit(2.5).alias("residual"))
    found = {(r.mz_bin, r.rt_bin): r for r in statistics.recalibration_surface(flat).collect()}
    assert found[-1, -1].centre == 2.5 and all(found[m, -1].centre == 2.5 for m in range(20)) and found[-1, -1].spread == 0
    assert not [k for k in found if k[1] >= 0]  # no cell has 50 rows
    assert statistics.recalibration_surface(flat.limit(49)).count() == 0


def test_medians_of_groups(spark):
    import random

    rows = [(g, random.Random(g * 1000 + i).choice([1.5, 2.0, float(i % 97)])) for g in range(5) for i in range(g * 50 + 1)]
    found = {r.g: (r.n, r["median"]) for r in statistics.medians(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    import statistics as plain

    assert found == {g: (g * 50 + 1, plain.median(v for k, v in rows if k == g)) for g in range(5)}


def test_runs_come_from_the_data(spark, tmp_path):
    kind = F.when(F.col("event_id") % 7 == 0, "refund").otherwise(F.col("event_type"))
    spark.read.parquet(f"{DATA}/events.parquet").withColumn("event_type", kind).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet(f"{DATA}/part.parquet").write.parquet(str(tmp_path / "part.parquet"))
    wide = registry.QUERIES["lfq_matrix"](spark, str(tmp_path))
    assert wide.columns == ["row", *sorted([*registry.RUNS, "refund"])]
    assert wide.agg(F.sum("refund")).first()[0] > 0
    assert registry.QUERIES["lfq_cells"](spark, str(tmp_path)).where("run = 'refund'").count() > 0
    with pytest.raises(ValueError):
        statistics.run_names(spark.range(3).select(F.col("id").cast("string").alias("run")), 2)
