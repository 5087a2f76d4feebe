"""From mzML files to matrices; chains' gates; scans scaled by their neighbours."""

import numpy as np
import pytest
from test_drivers import HILLS, TEMPLATE, envelope
from test_files import mzml, spectrum

from lumentrace.operators import alignment, batch, chains, consensus, drivers
from lumentrace.operators import isotopes as iso
from lumentrace.operators import quantification as qu
from lumentrace.operators import tracking as tk


def run_file(places, factor, late, level2=False):
    """Spectra a second apart with envelopes of three isotopes, a bell over 21 scans each."""
    scans = [[] for _ in range(700)]
    for mz, at, level in places:
        for d in range(-10, 11):
            height = level * factor * np.exp(-0.5 * (d / 4) ** 2)
            scans[at + late + d] += [(mz + k * iso.NEUTRON / 2, height * TEMPLATE[k]) for k in range(3)]
    out = []
    for i, peaks in enumerate(scans):
        peaks.sort()
        out.append(spectrum(1, i, [p[0] for p in peaks], [p[1] for p in peaks]))
        if level2 and i % 10 == 0:
            out.append(spectrum(2, i + 0.5, [200.0], [50.0], window=(500, 5)))
    parts = mzml(*out).split(b"<spectrum>")
    return parts[0] + b"".join(b'<spectrum index="%d">' % i + p for i, p in enumerate(parts[1:]))


def test_from_files_to_matrices(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 30
    places = list(zip(rng.uniform(450, 850, n).tolist(), (25 + 21 * np.arange(n)).tolist(), rng.uniform(1e4, 1e5, n).tolist()))
    (tmp_path / "in").mkdir()
    for run, factor, late in (("a", 1.0, 0), ("b", 2.0, 4)):
        (tmp_path / "in" / f"{run}.mzML").write_bytes(run_file(places, factor, late, level2=True))
    o = batch.Processing(chains=chains.Chains(charges=(2, 2), max_isotopes=2), recalibrate=False, fragments={"min_scans": 5})
    s = drivers.Study(grouping=consensus.Grouping(rt=0.5, cohorts=2, max_q=0.5), window_share=0.02, extraction=qu.Extraction(half_window=0.3, least_pattern=0.1), rounds=1, warping=alignment.Warping(draws=300))
    found = batch.study(spark, str(tmp_path / "in"), str(tmp_path / "out"), o, s, reference="a")
    assert found["hills"].groupBy("run").count().orderBy("run").collect() == [("a", 3 * n), ("b", 3 * n)]
    assert found["features"].groupBy("run", "n_isotopes").count().orderBy("run").collect() == [("a", 3, n), ("b", 3, n)]
    assert {(r.run, r.n_scans) for r in found["fragments"].collect()} <= {("a", 70), ("b", 70)}
    wide = spark.read.parquet(str(tmp_path / "out" / "intensity")).toPandas()
    # Quantities are scaled by run: the factor of two is in the factors.
    factor = {r.run: r.factor for r in found["factors"].collect()}
    assert len(wide) >= 0.8 * n and (wide.b / wide.a).median() == pytest.approx(1.0, rel=0.05) and factor["b"] - factor["a"] == pytest.approx(1.0, abs=0.05)
    assert found["report"].count() == 2


def test_predicted_intensity_ends_chains_below_the_floor(spark):
    rows = envelope("a", 0, 500.0, 2, 5.0, 1000.0) + envelope("a", 10, 700.0, 2, 3.0, 20.0)
    rows += [r for k in range(20) for r in envelope("a", 100 + 10 * k, 900.0 + 3 * k, 2, 8.0, 30.0, isotopes=1)]
    hills = spark.createDataFrame(rows, HILLS)
    plain, gate = ({(r.seed, len(r.members)) for r in chains.candidates(hills, chains.Chains(charges=(2, 2), max_isotopes=2, predicted_intensity=p)).collect()} for p in (False, True))
    # The faint seed's template puts its second isotope below the floor (0.8 of the apex at 5 %).
    heights = sorted(r[11] for r in rows)
    floor = heights[int(len(heights) * 0.05)] * 0.8
    assert (0, 3) in plain and (10, 3) in plain and (0, 3) in gate
    pattern = iso.with_patterns(spark.createDataFrame([((700.0 - iso.PROTON) * 2,)], "m double"), "m").first()["pattern"]
    apex = next(r[11] for r in rows if r[2] == 10)
    lasts = 1 + next((k for k in (1, 2) if apex * pattern[k] / pattern[0] < floor), 3) - 1
    assert max((n for seed, n in gate if seed == 10), default=1) == lasts


def test_claim_gate_leaves_lesser_prefixes(spark):
    good, odd = envelope("a", 0, 500.0, 2, 5.0, 1000.0), envelope("a", 10, 700.0, 2, 3.0, 1000.0)
    odd[2] = (*odd[2][:10], odd[2][10] * 4, odd[2][11] * 4, [x * 4 for x in odd[2][12]])
    hills = spark.createDataFrame(good + odd, HILLS)
    o = chains.Chains(charges=(2, 2), max_isotopes=2, max_log2_ratio=9.0, ratio_sigma=1.9)
    scored = chains.with_evidence(chains.candidates(hills, o), o).cache()
    prefix = {(r.seed, n): r.members[:n] for r in scored.collect() for n in range(2, len(r.members) + 1)}
    table = {}
    for (seed, n), members in prefix.items():
        heights = [m.intensity for m in members]
        by_id = {r[2]: r for r in good + odd}
        mass = (by_id[seed][3] - iso.PROTON) * 2
        pattern = np.array(iso.with_patterns(spark.createDataFrame([(mass,)], "m double"), "m").first()["pattern"])[: len(heights)]
        x = np.array(heights)
        table[seed, n] = float((np.sqrt(x * pattern).sum() / np.sqrt(x.sum() * pattern.sum())) * pattern.sum())
    least = sorted(table.values())[len(table) // 2]
    got = {(r.seed, k + 2): np.isfinite(x) for r in chains.gated(scored, hills, chains.Chains(charges=(2, 2), max_isotopes=2, min_isotope_score=least - 1e-9)).collect() for k, x in enumerate(r.scores)}
    assert got == {key: value >= least - 1e-9 for key, value in table.items()} and len(set(got.values())) == 2
    assert chains.gated(scored, hills, o) is scored


@pytest.mark.parametrize("median", [False, True])
def test_normalised_scans(spark, median):
    rng = np.random.default_rng(1)
    rows = [("r", None if s % 2 else 1.0, s, s / 60, 400.0 + k, float(rng.uniform(1, 9) * (20 if s == 7 else 1)), 0.0) for s in range(15) for k in range(3)]
    frame = spark.createDataFrame(rows, "run string, channel double, scan int, rt double, mz double, intensity double, im double")
    got = {(r.scan, r.mz): r.intensity for r in tk.normalised_scans(frame, 5, median=median).collect()}
    value = [(np.median if median else np.sum)([r[5] for r in rows if r[2] == s]) for s in range(15)]
    for r in rows:
        s = r[2]
        scale = min(3.0, max(0.5, np.median(value[max(0, s - 2) : s + 3]) / value[s]))
        assert got[s, r[4]] == pytest.approx(r[5] * scale, rel=1e-6)
