"""One call from hills to features, and from features and hills of runs to quantities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.operators import alignment, chains, consensus, drivers
from lumentrace.operators import isotopes as iso
from lumentrace.operators import quantification as qu

HILLS = "run string, channel double, hill_id long, mz double, rt double, rt_start double, rt_end double, im double, scan_start int, scan_end int, intensity_sum double, intensity_max double, profile array<double>"
TEMPLATE = [0.55, 0.3, 0.15]


def envelope(run, first, mz, charge, centre, height, ppm=lambda mz, rt: 0.0, isotopes=3):
    """Hills of scans two thousandths of a minute apart, their m/z off by a few ppm."""
    out, scans = [], np.arange(round(centre / 0.002) - 20, round(centre / 0.002) + 21)
    bell = np.exp(-0.5 * ((scans * 0.002 - centre) / 0.01) ** 2)
    for k in range(isotopes):
        p = height * TEMPLATE[k] * bell
        true = mz + k * iso.NEUTRON / charge
        out.append((run, None, first + k, true * (1 + ppm(true, centre) * 1e-6), float(centre), float(scans[0] * 0.002), float(scans[-1] * 0.002), 0.0, int(scans[0]), int(scans[-1]), float(p.sum()), float(p.max()), p.tolist()))
    return out


def test_recalibrated_features(spark):
    """A run whose spacings are too wide learns by how much, one of too few spacings goes without."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        rows += envelope("a", 10 * k, float(rng.uniform(400, 900)), 2, float(rng.uniform(1, 9)), 1000.0)
        mz = float(rng.uniform(400, 900))
        rows += [(*r[:3], r[3] + 0.002 * j, *r[4:]) for j, r in enumerate(envelope("b", 10 * k, mz, 2, float(rng.uniform(1, 9)), 1000.0, isotopes=2))]
    rows += envelope("c", 0, 500.0, 2, 5.0, 1000.0)
    hills = spark.createDataFrame(rows, HILLS)
    o = chains.Chains(charges=(2, 2), ppm=10.0, max_isotopes=2)
    found, surface = drivers.find_features(hills, o, least=50)
    units = {r.unit: r.centre for r in surface.where("mz_bin = -1").collect()}
    runs = {r.run: units.get(r.unit) for r in hills.select("run", chains.unit("run", "channel")).distinct().collect()}
    assert runs["a"] == pytest.approx(0.0, abs=0.01) and runs["b"] == pytest.approx(0.002 / 650 * 1e6, abs=0.5) and runs["c"] is None
    assert found.groupBy("run", "n_isotopes").count().orderBy("run").collect() == [("a", 3, 60), ("b", 2, 60), ("c", 3, 1)]
    # With a tolerance below the drift, the surface finds what plain targets miss.
    narrow = chains.Chains(charges=(2, 2), ppm=2.5, max_isotopes=1)
    b = hills.where("run = 'b'")
    assert chains.candidates(b, narrow).count() < 45 and chains.candidates(b, narrow, surface).count() >= 50
    few, none = drivers.find_features(hills.where("run = 'c'"), o)
    assert none is None and few.count() == 1


def test_from_features_to_quantities(spark):
    rng = np.random.default_rng(2)
    hills, features = [], []
    n = 40
    mz, rt, level = rng.uniform(400, 900, n), rng.uniform(1, 9, n), rng.uniform(1e3, 1e4, n)
    for r, (factor, late, ppm) in {"a": (1.0, 0.0, 0.0), "b": (2.0, 0.05, 3.0), "c": (0.5, -0.04, -2.0)}.items():
        for k in range(n):
            at = float(rt[k] + late)
            hills += envelope(r, 10 * k, float(mz[k]), 2, at, float(level[k] * factor), lambda m, t, ppm=ppm: ppm)
            if k % 8 or r != "c":  # some are missing from one run's features, not from its hills
                features.append((r, k, float(mz[k] * (1 + ppm * 1e-6)), 2, at, 0.0, 0.9))
        for k, end in enumerate((0.0, 10.0)):
            features.append((r, 1000 + k, 1200.0 + k, 2, end + late, 0.0, 0.9))
    hills = spark.createDataFrame(hills, HILLS)
    features = spark.createDataFrame(features, "run string, feature_id long, mz double, charge int, rt double, im double, score double")
    o = drivers.Study(grouping=consensus.Grouping(rt=0.1, cohorts=2, max_q=0.5), window_share=0.01, extraction=qu.Extraction(half_window=0.1, least_pattern=0.1), rounds=1, warping=alignment.Warping(draws=400))
    found = drivers.quantify(features, hills, "a", o)
    cells = found["cells"].where("not decoy").toPandas()
    assert len(cells) == 3 * found["groups"].count() and found["groups"].count() >= n
    real = cells[cells.ref_mz < 1000]
    assert (real.intensity > 0).all() and (real.ownership == "exclusive").all() and (abs(real.rt_apex - real.rt) < 0.02).all()
    assert (abs((real.observed_mz - real.mz) / real.mz) < 1e-6).all()
    factor = {r.run: r.factor for r in found["factors"].collect()}
    assert factor["b"] - factor["a"] == pytest.approx(1.0, abs=0.05) and factor["c"] - factor["a"] == pytest.approx(-1.0, abs=0.05)
    spread = real.groupby("group").intensity.agg(lambda x: x.max() / x.min())
    assert spread.median() < 1.1
    wide = drivers.matrices(found, ["a", "b", "c"])
    assert wide["intensity"].columns == [*drivers.FRONT, "a", "b", "c"] and wide["intensity"].count() == found["groups"].count()
    assert wide["consensus"].where("ref_mz < 1000").agg(F.min("n_detected")).first()[0] >= 0


def test_places_there_and_back(spark):
    """What a run measures goes to the reference and back to itself."""
    features = spark.createDataFrame([("a", 0.0, 500.0, 1.0), ("a", 10.0, 500.0, 1.0), ("b", 2.0, 500.0, 1.0), ("b", 5.0, 600.0, 1.1), ("b", 12.0, 700.0, 0.9)], "run string, rt double, mz double, im double")
    lines = spark.createDataFrame([("b", [0.0, 1.0], [0.02, 0.02])], "run string, knot_x array<double>, knot_y array<double>")
    drift = spark.createDataFrame([("b", 2.0, 3.0, 0.01, 0.02)], "run string, mz_slope double, mz_intercept double, im_slope double, im_intercept double")
    places = alignment.run_places(features, "a", lines, drift)
    there = alignment.to_reference(features, places)
    same = {(r.rt, r.mz, r.im) == (r.ref_rt, r.ref_mz, r.ref_im) for r in there.where("run = 'a'").collect()}
    assert same == {True}
    one = there.where("run = 'b' and mz = 600").first()
    x = (5.0 - 2.0) / 10.0 + 0.02
    assert one.ref_rt == pytest.approx(10 * x) and one.ref_mz == pytest.approx(600 / (1 + (3 + 2 * x) * 1e-6)) and one.ref_im == pytest.approx(1.1 - 0.02 - 0.01 * x)
    own = alignment.to_reference(features, places, own_axis=True).where("run = 'b' and mz = 600").first()
    assert own.ref_im == pytest.approx(1.1 - 0.02 - 0.01 * 0.3)
    back = alignment.to_runs(there.where("run = 'b' and mz = 600").select("ref_mz", "ref_rt", "ref_im"), places).where("run = 'b'").first()
    assert (back.rt, back.mz, back.im) == (pytest.approx(5.0), pytest.approx(600.0), pytest.approx(1.1))
