import random

import numpy as np
import pytest

from lumentrace.functions import profiles as kernels
from lumentrace.operators import tracking as tk

SCHEMA = "run string, channel double, scan int, rt double, mz double, intensity double, im double"


def spectra(spark, rows):
    return spark.createDataFrame([("r", c, s, 0.1 * s, mz, float(i), None) for c, s, mz, i in rows], SCHEMA)


def test_gaps_are_bridged_up_to_the_limit(spark):
    rows = [(None, s, 500.0, 100) for s in (0, 1, 3, 6, 7, 8)]
    spans = lambda gap, least: sorted((r.scan_start, r.scan_end, r.skipped_scans) for r in tk.track(spectra(spark, rows), tk.Tracking(max_gap=gap, min_scans=least)).collect())
    assert spans(0, 1) == [(0, 1, 0), (3, 3, 0), (6, 8, 0)]
    assert spans(1, 3) == [(0, 3, 1), (6, 8, 0)]
    assert spans(2, 3) == [(0, 8, 3)]


def test_interleaved_voltages_are_tracked_apart(spark):
    rows = []
    for cycle in range(3):
        rows += [(-50.0, cycle, 500.0, 10), (-50.0, cycle, 700.0, 20), (-65.0, cycle, 500.0, 30), (-80.0, cycle, 600.0, 40)]
    found = tk.numbered(tk.track(spectra(spark, rows), tk.Tracking(min_scans=2, max_gap=0))).orderBy("hill_id").collect()
    assert [(r.hill_id, r.channel, round(r.mz)) for r in found] == [(0, -80.0, 600), (1, -65.0, 500), (2, -50.0, 500), (3, -50.0, 700)]


def test_stronger_traces_choose_first_and_ties_go_low(spark):
    rows = [(None, 0, 500.000, 10), (None, 0, 500.008, 100), (None, 1, 500.004, 50)]
    found = tk.track(spectra(spark, rows), tk.Tracking(ppm=10, min_scans=1)).collect()
    assert sorted((r.scan_end, r.intensity_sum) for r in found) == [(0, 10.0), (1, 150.0)]
    rows = [(None, 0, 500.0, 10), (None, 1, 499.999, 1), (None, 1, 500.001, 2)]
    found = tk.track(spectra(spark, rows), tk.Tracking(ppm=10, min_scans=1)).collect()
    assert sorted(r.intensity_sum for r in found) in ([1.0, 12.0], [2.0, 11.0])


def test_islands_change_nothing(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, -40.0]), s, round(400 + rng.choice([0, 0.003, 0.01, 5, 5.002, 60]) + rng.gauss(0, 0.001), 5), rng.randint(1, 99)) for s in range(80) for _ in range(rng.randint(0, 5))]
    options = tk.Tracking(ppm=8, max_gap=1, min_scans=2)
    frame = spectra(spark, rows)
    whole = []
    for channel in (None, -40.0):
        part = frame.where(frame.channel.eqNullSafe(channel)).orderBy("scan", "mz", "intensity").collect()
        each = ((0, r.scan, r.rt, r.mz, r.intensity, 0.0) for r in part)
        whole += [(channel, h["scan_start"], round(h["mz"], 9), h["n_scans"], h["intensity_sum"]) for _, h in tk.tracked(each, options)]
    split = [(r.channel, r.scan_start, round(r.mz, 9), r.n_scans, r.intensity_sum) for r in tk.track(frame, options).collect()]
    key = lambda x: (x[0] or 0, *x[1:])
    assert sorted(whole, key=key) == sorted(split, key=key) and len(split) > 10
    assert tk.islands(frame, 8, 1).select("channel", "island").distinct().count() > 4


def test_apex_in_a_filled_gap_has_a_time(spark):
    rows = [(None, 0, 500.0, 100), (None, 2, 500.0, 100), (None, 3, 500.0, 10)]
    r = tk.track(spectra(spark, rows), tk.Tracking(fill=True, smooth=1)).first()
    assert r.skipped_scans == 1 and r.rt == pytest.approx(r.rt_start + r.rt_width * (r.scan_apex - r.scan_start) / 3)


def test_kernels():
    assert kernels.fill_gaps(np.array([100.0, 0, 200])).tolist() == [100, 150, 200]
    assert kernels.fill_gaps(np.array([100.0, 0, 0, 0, 200])).tolist() == [100, 125, 150, 175, 200]
    assert kernels.box_mean(np.array([0.0, 2, 4, 6, 8]), 1).tolist() == [1, 2, 4, 6, 7]
    assert kernels.shape_score(np.array([10.0, 80, 50, 100, 60, 30, 40, 5])) == pytest.approx(5 / 7)
    assert kernels.median_of_three(np.array([10.0, 9, 500, 11, 10])).tolist() == [10, 10, 11, 11, 10]
    assert kernels.covered(np.array([1.0, 2, 10, 3, 1]), 0.75) == (2, 3)


def test_segments_of_peaks():
    assert kernels.segments(np.array([1.0, 4, 1, 0, 1, 6, 1])) == [(0, 4), (4, 7)]
    assert kernels.segments(np.array([1.0, 4, 3, 4, 1])) == [(0, 5)] and kernels.segments(np.zeros(3)) == [(0, 3)] and kernels.segments(np.zeros(0)) == []


def test_two_peaks_are_split_and_one_is_not(spark):
    x = np.arange(100)
    bell = lambda c, s, n=100: 1000 * np.exp(-0.5 * ((np.arange(n) - c) / s) ** 2)
    assert len(kernels.split_points(bell(35, 5) + bell(65, 5))) == 1
    assert kernels.split_points(bell(40, 6, 80)) == []
    spiked = bell(40, 6, 80)
    spiked[12] = 1800
    assert kernels.split_points(spiked) == []
    two = bell(35, 5) + bell(65, 5) + 1
    frame = spectra(spark, [(None, int(s), 500.0, v) for s, v in zip(x, two)])
    parts = tk.split(tk.track(frame)).orderBy("scan_start").collect()
    assert [(r.scan_apex, r.n_scans) for r in parts] == [(35, 50), (65, 50)]
    assert parts[0].rt == pytest.approx(3.5) and sum(r.intensity_sum for r in parts) == pytest.approx(two.sum())


def test_baselines_go(spark):
    flat = spectra(spark, [(None, s, 500.0, 100 + s % 3) for s in range(60)] + [(None, s, 700.0, 1 + 500 * np.exp(-0.5 * ((s - 30) / 4) ** 2)) for s in range(60)])
    assert [round(r.mz) for r in tk.without_baselines(tk.track(flat)).collect()] == [700]


def test_noise_is_clipped(spark):
    rows = [(None, 0, 400.0 + k, 1) for k in range(8)] + [(None, 0, 600.0 + k, 1000) for k in range(2)]
    rows += [(None, 1, 400.0, 5), (None, 1, 500.0, 9)] + [(None, 2, 400.0 + k, k + 1) for k in range(5)] + [(None, 3, 400.0 + k, 7) for k in range(4)]
    kept = sorted((r.scan, r.intensity) for r in tk.clip_noise(spectra(spark, rows), 3.0).collect())
    assert kept == [(0, 1000.0), (0, 1000.0), (1, 5.0), (1, 9.0)]


def test_decoys_keep_every_peak(spark):
    rows = [(None, s, 400.0 + s, s + 1) for s in range(20)]
    frame = spectra(spark, rows)
    out = tk.shuffled_scans(frame, 1).collect()
    assert sorted(r.mz for r in out) == [400.0 + s for s in range(20)] and sorted(r.scan for r in out) == list(range(20))
    assert [r.scan for r in sorted(out, key=lambda r: r.mz)] != list(range(20))


def test_voltages_and_scans(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,), (-0.0,), (-50.0,)], "v double")
    assert [r[0] for r in rows.select(tk.channel_key(rows.v)).collect()] == [None, None, 0.0, -50.0]
    frame = spectra(spark, [(None, 7, 400.0, 1), (None, 9, 400.0, 1), (-1.0, 8, 400.0, 1)])
    assert sorted((r.channel or 0, r.scan) for r in tk.dense_scans(frame).collect()) == [(-1.0, 0), (0, 0), (0, 1)]
    assert tk.track(frame.limit(0)).count() == 0
