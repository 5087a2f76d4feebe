"""Exclusive quantification against a run through the cells one by one."""

import numpy as np
import pytest

from lumentrace.operators import isotopes as iso
from lumentrace.operators import ownership as ow
from lumentrace.operators import quantification as qu

HILLS = "run string, hill_id long, mz double, im double, rt double, rt_start double, rt_end double, intensity_sum double, profile array<double>"
CELLS = "cell_id long, group long, run string, decoy boolean, mz double, charge int, rt double, im double, template array<double>"
TEMPLATE = [0.6, 0.3, 0.1]
O = qu.Extraction(ppm=10.0, half_window=0.5, least_pattern=0.1)


def envelope(mz, peaks, first_id, run="a", charge=2, scans=100):
    out, x = [], (np.arange(scans) + 0.5) / scans
    for k, scale in enumerate(TEMPLATE):
        p = sum(h * scale * np.exp(-0.5 * ((x - c) / 0.02) ** 2) * (np.abs(x - c) <= 0.06) for c, h in peaks)
        out.append((run, first_id + k, mz + k * iso.NEUTRON / charge, 0.0, 0.5, float(x[0]), float(x[-1]), float(p.sum()), p.tolist()))
    return out


def cell(group, mz, rt, run="a", decoy=False, charge=2):
    return (group, group, run, decoy, mz, charge, rt, 0.0, TEMPLATE)


def resolve(spark, cells, hills, blocks=ow.Blocks()):
    found = ow.two_passes(spark.createDataFrame(cells, CELLS), spark.createDataFrame(hills, HILLS), O, blocks)
    return {(r.run, r.decoy, r.group): r for r in found.collect()}


def one_by_one(spark, cells, hills):
    """(intensity, owned, excluded, label, competitor) of each cell, with claimed samples in a set."""
    held = [r.asDict(recursive=True) for r in qu.traced(spark.createDataFrame(cells, CELLS), spark.createDataFrame(hills, HILLS), O).collect()]
    alone = {}
    for c in held:
        samples = qu.Samples.of(c)
        alone[c["run"], c["decoy"], c["group"]] = (c, samples, *qu.extracted(samples, c, O))
    fits = {}
    for (_, decoy, group), (c, _, found, _) in alone.items():
        fits.setdefault((decoy, group), [[], (c["charge"], c["mz"], c["rt"], c["im"])])
        fits[decoy, group][1] = min(fits[decoy, group][1], (c["charge"], c["mz"], c["rt"], c["im"]))
        if found["intensity"] > 0:
            fits[decoy, group][0].append(found["pattern"] * found["coelution"] * (1 - found["preceding"]))
    rank = {k: (-sum(sorted(v)) / max(1, len(v)), -len(v), *at, k[1]) for k, (v, at) in fits.items()}
    profiles = {(h[0], h[1]): np.array(h[-1]) for h in hills}
    claimed, out = {}, {}
    for run, decoy, group in sorted(alone, key=lambda k: (k[0], k[1], rank[k[1], k[2]])):
        c, samples, old, peak = alone[run, decoy, group]
        ids = list(zip(samples.hill.tolist(), samples.place.tolist()))
        taken = np.array([(run, decoy, *i) in claimed for i in ids], bool) if ids else np.zeros(0, bool)
        named = lambda which: {i for i, w in zip(ids, which) if w}  # noqa: B023, E731
        found, label, competitor = old, "exclusive", None
        excluded = named(taken & (samples.iso >= 0))
        if excluded:
            competitor = min((rank[decoy, claimed[(run, decoy, *i)]], claimed[(run, decoy, *i)]) for i in excluded)[1]
            support = named(peak)
            found, peak = qu.extracted(samples, c, O, ~taken)
            label = "residual"
            off = lambda x: abs(qu.apex_time(x, c) - c["rt"]) if x["apex"] >= 0 else np.nan  # noqa: B023, E731
            majority = 2 * len(support & named(taken)) >= len(support)
            meets = old["apex"] >= 0 and found["start"] <= old["end"] and found["end"] >= old["start"]
            if found["intensity"] <= 0:
                label = "shared_signal_only"
            elif len(set(samples.iso[peak].tolist())) < 2 or (majority and (meets or off(found) >= off(old))):
                label = "ambiguous_residual"
        mine = set() if label in ("shared_signal_only", "ambiguous_residual") else named(peak)
        value = found["intensity"] if mine else 0.0
        if value > 0:
            for hill, place in mine:
                p = profiles[run, hill]
                from lumentrace.functions.profiles import segments

                low, high = next(x for x in segments(p) if x[0] <= place < x[1])
                for i in range(low, high):
                    if p[i] > 0:
                        claimed[run, decoy, hill, i] = group
        out[run, decoy, group] = (round(value, 6), len(mine), len(excluded), label, competitor)
    return out


def test_random_cells_equal_one_by_one(spark):
    rng = np.random.default_rng(4)
    hills, cells = [], []
    for run in "ab":
        for k in range(14):
            peaks = [(float(c), float(h)) for c, h in zip(rng.uniform(0.1, 0.9, 2), rng.uniform(200, 1000, 2))]
            hills += envelope(500 + int(rng.integers(5)) * iso.NEUTRON / 2 + float(rng.uniform(-1, 1)) * 1e-3, peaks, 10 * k, run)
        for g in range(18):
            mz, rt = 500 + int(rng.integers(-1, 7)) * iso.NEUTRON / 2 + 1e-4 * float(rng.uniform(-1, 1)), float(rng.uniform(0.2, 0.8))
            cells += [cell(g, mz, rt, run), cell(g, mz + 0.25, rt - 0.01, run, True)]
            if g % 3 == 0:
                cells[-1] = cell(g, mz, rt - 0.05, run, True)
    want = one_by_one(spark, cells, hills)
    for blocks in (ow.Blocks(), ow.Blocks(mz=1.7, half_windows=0.5, most=6)):
        got = {k: (round(r.intensity, 6), r.owned_samples, r.excluded_samples, r.ownership, r.competitor) for k, r in resolve(spark, cells, hills, blocks).items()}
        assert got == want
    labels = {v[3] for v in got.values()}
    assert labels == {"exclusive", "residual", "shared_signal_only", "ambiguous_residual"}, labels


def test_one_peak_is_reported_once(spark):
    hills = envelope(500.0, [(0.5, 1000.0)], 0)
    found = resolve(spark, [cell(0, 500.0, 0.5), cell(1, 500.00001, 0.5), cell(2, 500.0 + iso.NEUTRON / 2, 0.5)], hills)
    assert [k[2] for k, r in found.items() if r.intensity > 0] == [0]
    assert found["a", False, 1].competitor == 0 and found["a", False, 1].ownership == "shared_signal_only"


def test_the_second_peak_of_a_long_trace_stays(spark):
    hills = envelope(500.0, [(0.3, 1000.0), (0.7, 700.0)], 0)
    found = resolve(spark, [cell(0, 500.0, 0.3), cell(1, 500.0, 0.7)], hills)
    first, second = found["a", False, 0], found["a", False, 1]
    assert (first.ownership, second.ownership) == ("exclusive", "residual")
    assert first.rt_apex == pytest.approx(0.3, abs=0.03) and second.rt_apex == pytest.approx(0.7, abs=0.03)


def test_targets_and_decoys_do_not_compete(spark):
    hills = envelope(500.0, [(0.5, 1000.0)], 0) + envelope(333.67151774, [(0.5, 800.0)], 10, charge=3) + envelope(500.05, [(0.5, 600.0)], 20)
    cells = [c for d in (False, True) for c in (cell(0, 500.0, 0.5, decoy=d), cell(1, 500.00001, 0.5, decoy=d), cell(2, 333.67151774, 0.5, decoy=d, charge=3), cell(3, 500.05, 0.5, decoy=d), cell(4, 900.0, 0.5, decoy=d))]
    found = resolve(spark, cells, hills)
    of = lambda d: [(found["a", d, g].intensity, found["a", d, g].excluded_samples, found["a", d, g].ownership) for g in range(5)]
    assert of(False) == of(True)
    assert [v > 0 for v, _, _ in of(False)] == [True, False, True, True, False] and [e for _, e, _ in of(False)][2:] == [0, 0, 0]


def test_slices_of_one_sparse_peak(spark):
    hills = [(r, i, mz, im, 0.5, 0.42, 0.58, s, [20.0 * t, 80.0 * t, 100.0 * t, 90.0 * t, 40.0 * t]) for (r, i, mz, im, _, _, _, s, _), t in zip(envelope(500.0, [(0.5, 1000.0)], 0), TEMPLATE)]
    found = resolve(spark, [cell(0, 500.0, 0.48), cell(1, 500.0, 0.52)], hills)
    assert sum(r.intensity > 0 for r in found.values()) == 1


def test_the_preceding_isotope_counts_under_the_peak_only(spark):
    base = cell(0, 500.0 + iso.NEUTRON / 2, 0.5)
    together = envelope(500.0, [(0.5, 1000.0)], 0)
    apart = envelope(500.0, [(0.2, 1000.0)], 0)[:1] + together[1:]
    value = lambda hills: qu.quantified(spark.createDataFrame([base], CELLS), spark.createDataFrame(hills, HILLS), O).first().preceding
    assert value(together) > 0.3 and value(apart) == 0


def test_modes_and_columns_of_a_cell(spark):
    hills = spark.createDataFrame(envelope(500.0, [(0.5, 1000.0)], 0), HILLS)
    cells = spark.createDataFrame([(*cell(0, 500.0, 0.45), 10, 2.0, False), (*cell(1, 500.0 + iso.NEUTRON, 0.5), 25, None, True)], CELLS + ", columns int, rt_sigma double, inferred boolean")
    rows = {r.group: r for r in qu.quantified(cells, hills, O).collect()}
    assert rows[0]["columns"] == 10 and rows[0].rt_score == pytest.approx(np.exp(-0.5 * ((rows[0].apex - 4.5) / 2.0) ** 2))
    assert rows[1].intensity == 0 and rows[1].n_found == 1  # inferred, of one isotope
    plain, along = (qu.quantified(cells.where("group = 0"), hills, qu.Extraction(half_window=0.5, projected=p, score="pattern", estimator="apex")).first() for p in (False, True))
    share = np.array(TEMPLATE)
    assert along.intensity == pytest.approx(plain.intensity * np.linalg.norm(share)) and along.intensity == along.apex_intensity
    assert plain.hybrid == plain.pattern


def test_priorities_do_not_depend_on_order(spark):
    names = "group long, decoy boolean, run string, intensity double, pattern double, coelution double, preceding double, charge int, mz double, rt double, im double"
    rows = [(g, False, r, 1.0, 0.5 + g / 10, 0.9, 0.1 * (i % 3), 2, 500.0, 1.0, 0.0) for g in range(3) for i, r in enumerate("abc")] + [(9, False, "a", 0.0, 0.9, 0.9, 0.0, 1, 1.0, 1.0, 0.0)]
    order = lambda rs: [r.group for r in ow.priorities(spark.createDataFrame(rs, names)).orderBy("rank").collect()]
    assert order(rows) == order(rows[::-1]) == [2, 1, 0, 9]
