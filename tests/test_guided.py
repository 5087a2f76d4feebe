"""From identifications to a long table of peptides by runs, its matrix, and its bundle."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_drivers import HILLS, envelope

from lumentrace.operators import alignment, drivers, guided, targets
from lumentrace.operators import isotopes as iso
from lumentrace.operators import quantification as qu
from lumentrace.sources import bundles

IDS = "run string, peptide string, charge int, mass double, rt double, q double, im double, row long"


def test_plan_and_labels(spark):
    ids = spark.createDataFrame([("a", "P", 2, 1000.0, 1.0, 0.01, None, 0), ("b", "P", 2, 1000.0, 1.1, 0.001, None, 1), ("a", "Q", 3, 1200.0, 2.0, 0.02, None, 2)], IDS)
    runs = spark.createDataFrame([("a", 300.0, 700.0), ("b", 450.0, 700.0), ("c", 300.0, 700.0)], "run string, low double, high double")
    aligned = spark.createDataFrame([("a",), ("b",)], "run string")
    planned = guided.plan(targets.expanded(targets.build(ids), runs, (2, 3)), ids, runs, aligned).cache()
    got = {(r.peptide, r.charge, r.run): (r.evidence, r.attempted, r.seed.row) for r in planned.collect()}
    assert got == {
        ("P", 2, "a"): ("direct_ms2", True, 1), ("P", 2, "b"): ("direct_ms2", True, 1), ("P", 2, "c"): ("mbr", False, 1),
        ("P", 3, "a"): ("inferred_charge", True, 1), ("P", 3, "b"): ("inferred_charge", True, 1), ("P", 3, "c"): ("mbr_inferred_charge", False, 1),
        ("Q", 3, "a"): ("direct_ms2", True, 2), ("Q", 3, "b"): ("mbr", True, 2), ("Q", 3, "c"): ("mbr", False, 2),
        ("Q", 2, "a"): ("inferred_charge", True, 2), ("Q", 2, "b"): ("mbr_inferred_charge", True, 2), ("Q", 2, "c"): ("mbr_inferred_charge", False, 2),
    }
    measured = spark.createDataFrame([("P", 2, "a", 5.0, 0.5), ("P", 2, "b", 6.0, 0.01), ("P", 3, "a", 7.0, 0.5), ("Q", 3, "b", 8.0, None), ("Q", 3, "c", 9.0, 0.0)], "peptide string, charge int, run string, intensity double, q double")

    def status(**kw):
        return {(r.peptide, r.charge, r.run): (r.status, r.accepted_intensity) for r in guided.labelled(planned, measured, **kw).collect()}

    plain = status()
    assert plain["P", 2, "a"] == ("rejected", 0.0) and plain["P", 2, "b"] == ("accepted", 6.0) and plain["Q", 3, "b"] == ("rejected", 0.0)
    assert plain["Q", 3, "c"] == ("not_attempted", 0.0) and plain["Q", 3, "a"] == ("no_signal", 0.0)
    free = status(gate_transfers_only=True)
    assert free["P", 2, "a"] == ("accepted", 5.0) and free["P", 3, "a"] == ("rejected", 0.0)
    assert status(scored=False)["P", 2, "b"] == ("unscored", 0.0)
    wide = guided.matrix(guided.labelled(planned, measured), ["a", "b", "c"]).where("peptide = 'P' and charge = 2").first()
    assert (wide.a, wide.b, wide.c) == (0.0, 6.0, 0.0)
    empty = guided.plan(targets.expanded(targets.build(ids.limit(0)), runs, (2, 3)), ids.limit(0), runs, aligned)
    assert guided.labelled(empty, measured).count() == 0


def test_from_identifications_to_a_bundle(spark, tmp_path):
    rng = np.random.default_rng(5)
    n, hills, features, ids = 40, [], [], []
    mass, rt, level = rng.uniform(900, 1700, n), rng.uniform(1, 9, n), rng.uniform(1e3, 1e4, n)
    for r, (factor, late) in {"a": (1.0, 0.0), "b": (2.0, 0.05)}.items():
        for k in range(n):
            at, mz = float(rt[k] + late), float(mass[k] / 2 + iso.PROTON)
            hills += envelope(r, 10 * k, mz, 2, at, float(level[k] * factor))
            features.append((r, k, mz, 2, at, 0.0, 0.9))
            if r == "a" or k % 4:  # a fourth of the peptides is identified in one run only
                ids.append((r, f"PEP{k}", 2, float(mass[k]), at, 0.001 * (k % 9 + 1), None, len(ids)))
        for k, end in enumerate((0.0, 10.0)):
            features.append((r, 1000 + k, 1200.0 + k, 2, end + late, 0.0, 0.9))
    ids.append(("a", "BAD", 2, 1000.0, 1.0, 0.01, None, 900))
    ids.append(("b", "BAD", 2, 1001.0, 1.0, 0.01, None, 901))
    features = spark.createDataFrame(features, "run string, feature_id long, mz double, charge int, rt double, im double, score double")
    o = drivers.Study(window_share=0.01, extraction=qu.Extraction(half_window=0.1, least_pattern=0.1), rounds=1, warping=alignment.Warping(draws=400))
    found = guided.quantify(spark.createDataFrame(ids, IDS), features, spark.createDataFrame(hills, HILLS), "a", o, charges=None, min_anchors=10)
    long = found["peptide_quant"].toPandas()
    assert len(long) == 2 * n and set(long.evidence) == {"direct_ms2", "mbr"} and (long.intensity > 0).all()
    both = long.pivot(index="peptide", columns="run", values="intensity")
    assert (both.b / both.a).median() == pytest.approx(2.0, rel=0.05)
    assert (long[long.evidence == "mbr"].run == "b").all() and len(long[long.evidence == "mbr"]) == 10
    assert [tuple(r) for r in found["search_rejections"].collect()] == [("BAD", 2, "inconsistent mass")]
    source = tmp_path / "ids.tsv"
    source.write_text("x")
    guided.write(found, str(tmp_path / "out"), {"ids": str(source)})
    manifest, tables = bundles.read(spark, str(tmp_path / "out"))
    assert set(tables) == {"peptide_quant", "peptide_intensity_matrix", "search_rejections"} and manifest["most_q"] == 0.05
    assert tables["peptide_intensity_matrix"].columns == ["peptide", "charge", "a", "b"]
    assert tables["peptide_quant"].agg(F.sum("intensity")).first()[0] == pytest.approx(long.intensity.sum())
