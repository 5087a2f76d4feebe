"""Rescoring against a numpy run of the same folds, rounds and rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.operators import rescoring as rs

ROWS = "id long, group long, decoy boolean, intensity double, hybrid double, ppm double, rt_off double, pattern double, coelution double, im_off double, peptide string, charge int"


def made(n, seed=0, peptides=60):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        decoy, good = i % 2 == 1, rng.random() < 0.6
        shift = 0.0 if decoy or not good else 1.5
        values = [float(v) for v in rng.normal(shift, 1.0, 4)]
        values[0] = float("nan") if i % 17 == 0 else values[0]
        group = i // 2
        out.append((i, group, decoy, 0.0 if i % 23 == 0 else 1.0, float(np.round(1 / (1 + np.exp(-rng.normal(shift, 1.0))), 2)), *values, None, f"PEP{group % peptides}", 2 + group % 3))
    return out


def qvalues(score, decoy, conservative):
    order = np.lexsort((np.arange(len(score)), -score))
    t, d = np.cumsum(~decoy[order]), np.cumsum(decoy[order])
    q = np.ones(len(score))
    if conservative:
        ends = {}
        for k, i in enumerate(order):
            ends[score[i]] = (t[k], d[k])
        low = 1.0
        for s in sorted(ends):
            low = min(low, (ends[s][1] + 1) / max(1, ends[s][0]))
            q[(score == s) & ~decoy] = low
        return q
    low = 1.0
    for k in range(len(order) - 1, -1, -1):
        if not decoy[order[k]]:
            low = min(low, d[k] / t[k])
            q[order[k]] = low
    return q


def gaussian(x):
    if len(x) < x.shape[1] + 2:
        return None
    c = np.cov(x.T) + 1e-2 * np.eye(x.shape[1])
    return x.mean(0), np.linalg.inv(c), np.linalg.slogdet(c)[1]


def learnt(x, decoy, start, rounds, least, conservative):
    score, model = start.copy(), None
    for _ in range(rounds):
        q = qvalues(score, decoy, conservative)
        pos = np.flatnonzero(~decoy & (q <= 0.01))
        if len(pos) < least:
            targets = np.flatnonzero(~decoy)
            pos = targets[np.lexsort((targets, -score[targets]))][:least]
        a, b = gaussian(x[pos]), gaussian(x[decoy])
        if a is None or b is None:
            break
        value = lambda z, a=a, b=b: -0.5 * np.einsum("ij,jk,ik->i", z - a[0], a[1], z - a[0]) - 0.5 * a[2] + 0.5 * np.einsum("ij,jk,ik->i", z - b[0], b[1], z - b[0]) + 0.5 * b[2]
        sign = -1 if value(x[pos]).mean() < value(x[decoy]).mean() else 1
        model = lambda z, value=value, sign=sign: sign * value(z)
        score = model(x)
    return model


def standard(x, train):
    t = x[train]
    middle = np.array([np.sort(c[np.isfinite(c)])[np.isfinite(c).sum() // 2] if np.isfinite(c).any() else 0.0 for c in t.T])
    fill = lambda z: np.where(np.isfinite(z), z, middle)
    mean, sd = fill(t).mean(0), fill(t).std(0)
    return (fill(x) - mean) / np.where(sd < 1e-12, 1.0, sd)


def columns(rows):
    rows = [r for r in rows if r[3] > 0]
    x = np.array([[np.nan if v is None else v for v in r[5:10]] for r in rows], float)
    return [r[0] for r in rows], x, np.array([r[2] for r in rows]), np.array([r[4] for r in rows]), rows


def test_nested_folds_equal_numpy(spark):
    rows = made(600)
    ids, x, decoy, hybrid, kept = columns(rows)
    x, fold = standard(x, np.ones(len(x), bool)), np.array([r[1] % 3 for r in kept])
    held = hybrid.copy()
    for f in range(3):
        tr = fold != f
        held[fold == f] = learnt(x[tr], decoy[tr], hybrid[tr], 3, 60, False)(x[fold == f])
    want = dict(zip(ids, zip(held, qvalues(held, decoy, False))))
    got = {r.id: (r.score, r.q) for r in rs.rescored(spark.createDataFrame(rows, ROWS), rounds=3, least=60).collect()}
    assert got.keys() == {r[0] for r in rows} and all(got[r[0]] == (None, 1.0) for r in rows if r[3] == 0)
    for i, (score, q) in want.items():
        assert got[i][0] == pytest.approx(score, abs=1e-6) and (decoy[ids.index(i)] or got[i][1] == pytest.approx(q, abs=1e-9))


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h % 3


def test_peptide_folds(spark):
    texts = ["", "A", "PEPTIDE", "é\U0001f600", "x" * 200]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rs.fnv1a(F.col("t"), 3).alias("f")).collect()
    assert {r.t: r.f for r in got} == {t: fnv(t) for t in texts}


@pytest.mark.parametrize("support", [(20, 20, 5), (10_000, 1, 1)])
def test_strata_equal_numpy(spark, support):
    rows = made(700, seed=2)
    ids, x, decoy, hybrid, kept = columns(rows)
    fold = np.array([fnv(r[10]) for r in kept])
    stratum = np.array([r[11] if r[11] in (2, 3) else 0 for r in kept]) if support[0] < 1000 else np.full(len(kept), -1)
    held, q = hybrid.copy(), np.ones(len(kept))
    for s in set(stratum.tolist()):
        mine = stratum == s
        for f in range(3):
            tr, te = mine & (fold != f), mine & (fold == f)
            z = standard(x, tr)
            held[te] = learnt(z[tr], decoy[tr], hybrid[tr], 2, 40, True)(z[te])
        q[mine] = qvalues(held[mine], decoy[mine], True)
    got = {r.id: r for r in rs.search_rescored(spark.createDataFrame(rows, ROWS), rounds=2, least=40, support=support).collect()}
    assert len(got) == len(rows)
    for k, i in enumerate(ids):
        assert got[i].stratum == stratum[k] and got[i].score == pytest.approx(held[k], abs=1e-6)
        assert got[i].q == (1.0 if decoy[k] else pytest.approx(q[k], abs=1e-9))


def test_without_decoys_or_models(spark):
    rows = [r for r in made(80) if not r[2]]
    assert rs.rescored(spark.createDataFrame(rows, ROWS)).where("q > 0 and score is not null").count() == 0
    few = spark.createDataFrame(made(14), ROWS)
    found = {r.id: r.score for r in rs.search_rescored(few, mode="peptide_grouped", rounds=1).collect()}
    assert found == {r[0]: r[4] if r[3] > 0 else None for r in made(14)}
    assert rs.search_rescored(few.limit(0)).count() == 0
