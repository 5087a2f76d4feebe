"""Greedy grouping in blocks against a run through the rows in quality order."""

import math

import numpy as np
import pytest

from lumentrace.operators import consensus as co

ROWS = "run string, feature_id long, charge int, mass double, rt double, im double, score double"


def one_by_one(rows, o):
    """{(run, feature_id): name of the group's seed}, in quality order."""
    groups, out = [], {}
    for run, i, charge, mass, rt, im, score in sorted(rows, key=lambda r: (-r[6], r[2], r[3], r[4], r[5], r[0], r[1])):
        best = None
        for n, g in enumerate(groups):
            if g["charge"] != charge or not mass / (1 + o.ppm * 1e-6) <= g["seed"][0] <= mass * (1 + o.ppm * 1e-6):
                continue
            masses, times = [*g["mass"], mass], [*g["rt"], rt]
            ims = [*g["im"], *([im] if im != 0 else [])]
            if (max(masses) - min(masses)) / min(masses) * 1e6 > o.ppm or max(times) - min(times) > o.rt or (ims and max(ims) - min(ims) > o.im):
                continue
            s = g["seed"]
            far = ((mass - s[0]) / s[0] * 1e6 / o.ppm) ** 2 + ((rt - s[1]) / o.rt) ** 2 + (((im - s[2]) / o.im) ** 2 if im != 0 and s[2] != 0 else 0)
            if best is None or far < best[0]:
                best = (far, n)
        if best is None:
            groups.append({"charge": charge, "seed": (mass, rt, im), "name": f"{run}:{i}", "mass": [], "rt": [], "im": []})
            best = (0, len(groups) - 1)
        g = groups[best[1]]
        g["mass"].append(mass)
        g["rt"].append(rt)
        g["im"] += [im] if im != 0 else []
        out[run, i] = g["name"]
    return out


@pytest.mark.parametrize("side", [3, 32])
def test_dense_rows_equal_one_by_one(spark, side):
    """Masses without an empty stretch, so that every block touches others."""
    rng, o = np.random.default_rng(8), co.Grouping(ppm=10.0, rt=1.0, im=0.05)
    n = 400
    mass = 1000 * np.exp(np.sort(rng.uniform(0, 26 * math.log1p(1e-5), n)))
    rows = [(f"r{k % 5}", k, int(2 + k % 2), float(mass[k]), float(rng.uniform(0, 6)), float(rng.choice([0.0, rng.uniform(0.9, 1.1)])), float(rng.choice([0.5, rng.uniform(0, 1)]))) for k in range(n)]
    found = co.clusters(spark.createDataFrame(rows, ROWS), o, side=side)
    assert {(r.run, r.feature_id): r.group_id for r in found.collect()} == one_by_one(rows, o)


def test_equal_rows_and_none(spark):
    rows = [(f"r{k}", k, 2, 1000.0, 5.0, 0.0, 0.5) for k in range(50)]
    frame = spark.createDataFrame(rows, ROWS)
    assert {r.group_id for r in co.clusters(frame).collect()} == {"r0:0"}
    assert co.clusters(frame.limit(0)).count() == 0
