import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.operators import chains as ch
from lumentrace.operators import isotopes as iso
from lumentrace.operators import statistics as st


def plain_pattern(c, h, n, o, s):
    t = iso.element_tables()
    out = np.array([1.0] + [0.0] * 9)
    for e, k in zip("chnos", (c, h, n, o, s)):
        out = np.convolve(out, t[e][k])[:10]
    return out / out.sum()


def test_element_tables():
    t = iso.element_tables()
    assert t["c"][0].tolist() == [1.0] + [0.0] * 9
    assert t["c"][1][:3].tolist() == [0.9893, 0.0107, 0.0]
    assert t["c"][2][:3] == pytest.approx([0.9893**2, 2 * 0.9893 * 0.0107, 0.0107**2])
    a, b = plain_pattern(67, 105, 18, 20, 0), plain_pattern(67, 105, 18, 20, 2)
    assert a.sum() == pytest.approx(1) and b[2] > 1.1 * a[2]


def test_patterns_of_masses(spark):
    masses = [0.0, 500.0, 1500.0, 2664.0, 2700.0, 60_000.0]
    rows = iso.with_patterns(spark.createDataFrame([(m,) for m in masses], "mass double"), "mass", [-1, 0, 1]).collect()
    for r in rows:
        k = {e.lower(): int(x * r.mass / iso.RESIDUE_MASS + 0.5) for e, x in iso.RESIDUE.items()}
        k = {e: min(v, iso.ISOTOPES[e][1]) for e, v in k.items()}
        assert r.pattern == pytest.approx(plain_pattern(*[k[e] for e in "chnos"]).tolist())
        up = int(np.ceil(0.0417 * r.mass / iso.RESIDUE_MASS))
        assert [t.sulfur for t in r.templates] == list(dict.fromkeys(max(0, up + o) for o in (-1, 0, 1)))
        for t in r.templates:
            assert t.pattern == pytest.approx(plain_pattern(k["c"], k["h"], k["n"], k["o"], min(20, t.sulfur)).tolist())


def test_scores(spark):
    mass = 1500.0
    rows = iso.with_patterns(spark.createDataFrame([(mass,)], "mass double"), "mass", [-1, 0, 1])
    p = rows.first()["pattern"]
    two = [float(x) for x in plain_pattern(67, 105, 18, 20, 2)[:4]]
    lit = lambda x: F.array(*map(F.lit, x)).cast("array<double>")
    r = rows.select(iso.affinity(lit(p[:4]), F.col("pattern")).alias("a"), iso.affinity(lit([]), F.col("pattern")).alias("b"), iso.affinity(lit([0.0, 0.0]), F.col("pattern")).alias("c"), iso.best_affinity(lit(two), F.col("templates")).alias("d")).first()
    assert r.a == pytest.approx(sum(p[:4])) and (r.b, r.c) == (0, 0)
    plain = lambda t: sum((x / sum(two) * y / sum(t[:4])) ** 0.5 for x, y in zip(two, t)) * sum(t[:4])
    want = {t.sulfur: plain(t.pattern) for t in rows.first()["templates"]}
    assert r.d.score == pytest.approx(max(want.values())) and r.d.sulfur == max(want, key=want.get)


def test_feature_scores_and_offsets(spark):
    mz, z = 751.0, 2
    mass = mz * z - z * iso.PROTON
    p = iso.with_patterns(spark.createDataFrame([(mass,)], "mass double"), "mass").first()["pattern"]
    rows = [(1, mz, z, p[:4], 0.9), (2, mz, z, [0.001, *p[:4]], 1.5), (3, mz, 0, p[:2], 1.0)]
    scored = iso.score_features(spark.createDataFrame(rows, "id int, mz double, charge int, observed array<double>, cosine_score double"), search=True)
    got = {r.id: r for r in scored.collect()}
    assert set(got) == {1, 2} and (got[1].neutron_offset, got[2].neutron_offset) == (0, 1)
    assert got[1].combined_score == pytest.approx(0.9 * sum(p[:4])) and got[2].combined_score == pytest.approx(got[2].isotope_score)
    assert got[1].theoretical_pattern == pytest.approx([x / sum(p[:4]) for x in p[:4]])
    assert [r.id for r in iso.retained(scored, isotope=0.97, cosine=0.95).collect()] == [2]
    low = iso.score_features(spark.createDataFrame(rows[1:2], "id int, mz double, charge int, observed array<double>, cosine_score double"), search=True, floor=2.0)
    assert low.first()["neutron_offset"] == 0


HILLS = "run string, channel double, hill_id long, mz double, rt double, rt_start double, rt_end double, im double, scan_start int, scan_end int, intensity_sum double, intensity_max double, profile array<double>"
BELL = [100.0, 500.0, 1000.0, 500.0, 100.0]


def hills(spark, rows):
    """(channel, id, mz, scale, start)"""
    return spark.createDataFrame([("r", c, i, mz, s + 2.0, float(s), s + 4.0, 0.0, s, s + 4, x * sum(BELL), x * 1000.0, [x * v for v in BELL]) for c, i, mz, x, s in rows], HILLS)


def envelope(channel, first, mz, z, scale, start, n=4):
    mass = mz * z - z * iso.PROTON
    k = {e.lower(): int(x * mass / iso.RESIDUE_MASS + 0.5) for e, x in iso.RESIDUE.items()}
    p = plain_pattern(*[k[e] for e in "chnos"])
    return [(channel, first + i, mz + i * iso.NEUTRON / z, float(scale * p[i] / p[0]), start) for i in range(n)]


def test_two_hills_join_only_in_one_channel(spark):
    step = iso.NEUTRON / 2
    for second, n in ((-50.0, 1), (-65.0, 0)):
        found = ch.candidates(hills(spark, [(-50.0, 0, 500.0, 1.0, 0), (second, 1, 500.0 + step, 0.55, 0)]), ch.Chains(charges=(1, 2), max_isotopes=2))
        assert found.where("charge = 2").count() == n


def test_chains_are_found_and_used_once(spark):
    rows = envelope(None, 0, 500.0, 2, 1.0, 10) + envelope(None, 10, 700.0, 3, 0.6, 10, 3) + envelope(None, 20, 500.25, 1, 0.4, 40, 3) + [(None, 30, 900.0, 1.0, 0)]
    frame = hills(spark, rows)
    chains = ch.resolved(ch.with_evidence(ch.candidates(frame, ch.Chains(max_isotopes=4))))
    found = {r.seed: (r.charge, [m.hill_id for m in r.members]) for r in chains.collect()}
    assert found == {0: (2, [0, 1, 2, 3]), 10: (3, [10, 11, 12]), 20: (1, [20, 21, 22])}
    out = {r.seed: r for r in ch.features(chains, frame).collect()}
    assert out[0].n_isotopes == 4 and out[0].cosine_score == pytest.approx(1) and out[0].ppm_error == pytest.approx(0, abs=1e-6)
    assert (out[0].apex_scan, out[0].scan_start, out[0].rt_start, out[0].rt_end) == (12, 10, 10.0, 14.0)
    assert out[0].mass == pytest.approx(2 * 500.0 - 2 * iso.PROTON) and out[0].intensity_apex == pytest.approx(sum(out[0].observed))
    scored = iso.score_features(ch.features(chains, frame)).collect()
    assert min(r.isotope_score for r in scored) > 0.8  # three isotopes of a heavy one hold 0.84 of it


def test_resolution_equals_one_heap(spark):
    """Against a plain greedy pass on made-up chains that share hills."""
    import heapq
    import random

    rng = random.Random(4)
    items = []
    for seed in range(40):
        for charge in (1, 2):
            ids = [seed] + rng.sample([i for i in range(40) if i > seed] or [99 + seed], 1) + ([100 + rng.randrange(30)] if rng.random() < 0.6 else [])
            items.append((seed, charge, ids, [round(rng.uniform(-1, 5), 3) for _ in ids[1:]]))

    def best(ids, scores):
        ends = [(-s, i + 2) for i, s in enumerate(scores[: len(ids) - 1])]
        return min(ends) if ends else None

    heap = [(best(ids, s)[0], seed, charge, ids[: best(ids, s)[1]], s) for seed, charge, ids, s in items]
    heapq.heapify(heap)
    used, want = set(), {}
    while heap:
        e, seed, charge, ids, s = heapq.heappop(heap)
        free = next((i for i, x in enumerate(ids) if x in used), len(ids))
        if free == len(ids):
            used.update(ids)
            want[seed, charge] = ids
        elif free >= 2:
            e, n = best(ids[:free], s)
            heapq.heappush(heap, (e, seed, charge, ids[:n], s))
    rows = [("r", None, seed, charge, float(seed), [(i, 0.0, 1.0, 1.0) for i in ids], s) for seed, charge, ids, s in items]
    frame = spark.createDataFrame(rows, "run string, channel double, seed long, charge int, seed_mz double, members array<struct<hill_id:long,mz:double,intensity:double,cosine:double>>, scores array<double>")
    assert {(r.seed, r.charge): [m.hill_id for m in r.members] for r in ch.resolved(frame).collect()} == want


def test_residuals_and_lookup(spark):
    rows = [x for k in range(12) for x in envelope(None, 10 * k, 400.0 + 20 * k, 2, 1.0, 10 * k, 2)]
    rows = [(c, i, mz * (1 + (2.5e-6 if i % 10 else 0)), s, t) for c, i, mz, s, t in rows]
    frame, two = hills(spark, rows), ch.Chains(charges=(2, 2), max_isotopes=2)
    chains = ch.resolved(ch.with_evidence(ch.candidates(frame, two)))
    residuals = ch.spacing_residuals(ch.features(chains, frame), frame)
    assert residuals.count() == 12 and residuals.agg(F.avg("residual")).first()[0] == pytest.approx(2.5, abs=0.01)
    surface = st.recalibration_surface(residuals, least=5)
    at = ch.looked_up(spark.createDataFrame([(500.0, 20.0), (1e6, -5.0)], "mz double, rt double"), surface).collect()
    assert [r.centre for r in at] == pytest.approx([2.5, 2.5], abs=0.01)
    again = ch.candidates(frame, two, surface)
    assert again.where("charge = 2").count() == 12
    cells = spark.range(4000).select(F.when(F.col("id") < 2000, 400.0).otherwise(1200.0).alias("mz"), (F.col("id") % 60).cast("double").alias("rt"), F.when(F.col("id") < 2000, 1.0).otherwise(-3.0).alias("residual"))
    at = ch.looked_up(spark.createDataFrame([(400.0, 5.0), (1200.0, 5.0), (800.0, 5.0)], "mz double, rt double"), st.recalibration_surface(cells)).collect()
    assert [r.centre for r in at] == [1.0, -3.0, -1.0]
