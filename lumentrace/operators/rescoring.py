"""Rescoring of cells: a quadratic discriminant of targets against decoys, learnt on other folds only.

All folds of all strata are fitted side by side: a cell is a training row of
every fold but its own, ``unit`` names fold and stratum, and each round ranks,
picks and sums all units in one pass.  A unit's moments (a few dozen numbers)
reach the driver, where its two Gaussians are fitted; scores are expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.functions.lineage import cut_lineage
from lumentrace.operators import statistics as st

FOLDS, ROUNDS, MOST_Q, LEAST_POSITIVES, RIDGE = 3, 10, 0.01, 1000, 1e-2
#: Training targets, decoys and peptides that a stratum must have in every fold to be scored by itself.
SUPPORT = (100, 100, 20)
BASE = ["ppm", "rt_off", "pattern", "coelution", "im_off"]
QUALITY = ["isotopes", "width", "preceding"]
#: Mode -> features; signed ones keep the direction of mass and time.
MODES = {"legacy": BASE, "peptide_grouped": BASE, "charge_stratified": BASE, "charge_signed": BASE, "charge_signed_quality": BASE + QUALITY}


def cell_features(found: DataFrame, mode: str = "legacy") -> DataFrame:
    """``found`` (of ``quantified``) with the mode's features; null where there is no such value."""
    signed = (lambda c: c) if "signed" in mode else F.abs
    made = {
        "ppm": F.when(F.col("mz") > 0, signed((F.col("observed_mz") - F.col("mz")) / F.col("mz") * 1e6)),
        "rt_off": signed(F.col("rt_apex") - F.col("rt")),
        "im_off": F.when(F.col("im") != 0, F.abs(F.col("observed_im") - F.col("im"))),
    }
    if mode == "charge_signed_quality":
        made |= {"isotopes": F.log1p("n_found"), "width": F.log1p(F.greatest(F.lit(0.0), F.col("peak_width")))}
    return found.withColumns(made)


def fnv1a(text: Column, folds: int) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes modulo ``folds``, in two halves of 32 bits."""
    half = (1 << 32) - 1
    code = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("long"))
    state = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(s, byte):
        # times 2^40 + 435, modulo 2^64
        lo = s.lo.bitwiseXOR(byte)
        p = lo * 435
        hi = (s.hi * 435 + F.shiftright(p, 32) + F.shiftleft(lo, 8)).bitwiseAND(half)
        return F.struct(hi.alias("hi"), p.bitwiseAND(half).alias("lo"))

    return F.aggregate(F.when(F.length(code) > 0, bytes_).otherwise(F.array().cast("array<long>")), state, step, lambda s: (((s.hi % folds) * (2**32 % folds) + s.lo) % folds).cast("int"))


@dataclass(frozen=True)
class Quadratic:
    """Log ratio of two Gaussians, turned so that positives score higher."""

    means: tuple[np.ndarray, np.ndarray]
    inverses: tuple[np.ndarray, np.ndarray]
    logdets: tuple[float, float]
    sign: float = 1.0

    def score(self, x: list[Column]) -> Column:
        def density(mean, inverse, logdet):
            off = [c - float(m) for c, m in zip(x, mean)]
            far = reduce(lambda a, b: a + b, [float(inverse[i, j]) * (1 if i == j else 2) * off[i] * off[j] for i in range(len(x)) for j in range(i + 1)])
            return -0.5 * far - 0.5 * logdet

        target, decoy = (density(m, a, d) for m, a, d in zip(self.means, self.inverses, self.logdets))
        return self.sign * (target - decoy)

    def mean_score(self, mean: np.ndarray, spread: np.ndarray) -> float:
        """The mean score of rows with this mean and (population) covariance."""
        far = [np.trace(a @ spread) + (mean - m) @ a @ (mean - m) for m, a in zip(self.means, self.inverses)]
        return float(self.sign * (-0.5 * far[0] - 0.5 * self.logdets[0] + 0.5 * far[1] + 0.5 * self.logdets[1]))


def fitted(moments: list[tuple[int, np.ndarray, np.ndarray]], ridge: float = RIDGE) -> Quadratic | None:
    """Of (n, mean, summed squares about the mean) of positives and decoys; None where either has too few rows."""
    k = len(moments[0][1]) if moments else 0
    if len(moments) < 2 or any(n < k + 2 for n, _, _ in moments):
        return None
    covariances = [s / (n - 1) + ridge * np.eye(k) for n, _, s in moments]
    if any(np.linalg.eigvalsh(c).min() <= 0 for c in covariances):
        return None
    model = Quadratic(tuple(m for _, m, _ in moments), tuple(map(np.linalg.inv, covariances)), tuple(float(np.linalg.slogdet(c)[1]) for c in covariances))
    ahead, behind = (model.mean_score(m, s / n) for n, m, s in moments)
    return Quadratic(model.means, model.inverses, model.logdets, -1.0) if ahead < behind else model


def _moments(rows: DataFrame, features: list[str]) -> dict:
    """{(unit, decoy): (n, mean, summed squares about the mean)}."""
    k = len(features)
    sums = [F.count("*").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(features)], *[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i + 1)]]
    out = {}
    for r in rows.groupBy("unit", "decoy").agg(*sums).collect():  # two rows a unit
        mean = np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
        square = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
        out[r["unit"], r["decoy"]] = (r["n"], mean, square - r["n"] * np.outer(mean, mean))
    return out


def _learnt(train: DataFrame, features: list[str], rounds: int, conservative: bool, least: int = LEAST_POSITIVES) -> dict[int, Quadratic]:
    """The last model of each unit.  ``train`` has unit, id, decoy, score (where to start) and standardised features."""
    now, models = cut_lineage(train), {}
    units = sorted(r["unit"] for r in now.select("unit").distinct().collect())  # a handful
    for _ in range(rounds):
        ranked = now.withColumns({"t": (~F.col("decoy")).cast("int"), "d": F.col("decoy").cast("int")})
        ranked = st.cumulated(ranked, ["unit"], [F.desc("score"), F.col("id")], ["t", "d"])
        if conservative:
            ends = ranked.groupBy("unit", "score").agg(F.max("upto_t").alias("upto_t"), F.max("upto_d").alias("upto_d"), F.max("t").alias("t"))
            picked = ends.where((F.col("t") > 0) & ((F.col("upto_d") + 1) / F.greatest(F.lit(1), F.col("upto_t")) <= MOST_Q))
        else:
            picked = ranked.where(~F.col("decoy") & (F.col("upto_d") / F.greatest(F.lit(1), F.col("upto_t")) <= MOST_Q))
        # The targets down to the last one with a low rate; the best ones where those are few.
        counts = {r["unit"]: r["n"] for r in picked.groupBy("unit").agg(F.max("upto_t").alias("n")).collect()}
        most = F.coalesce(*[F.when(F.col("unit") == u, max(least, counts.get(u, 0))) for u in units], F.lit(least))
        moments = _moments(ranked.where(F.col("decoy") | (F.col("upto_t") <= most)), features)
        fresh = {u: fitted([moments[u, d] for d in (False, True) if (u, d) in moments]) for u in units}
        fresh = {u: m for u, m in fresh.items() if m is not None}
        models |= fresh
        if not fresh:
            break
        score = F.coalesce(*[F.when(F.col("unit") == u, m.score([F.col(f) for f in features])) for u, m in fresh.items()], F.lit(0.0))
        now = now.where(F.col("unit").isin(list(fresh))).select("unit", "id", "decoy", score.alias("score"), *features)
    return models


def _standards(rows: DataFrame, features: list[str]) -> dict:
    """{unit: (upper medians, means, spreads)} of the features, missing ones counted as the median."""
    value = lambda f: F.when(F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(F.col(f)) < float("inf")), F.col(f).cast("double"))
    each = rows.select("unit", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value(f).alias("v")) for i, f in enumerate(features)])).alias("x")).select("unit", "x.*").where("v is not null")
    found = {(r["unit"], r["i"]): r["median"] for r in st.medians(each, ["unit", "i"], "v", upper=True).collect()}  # a row for each unit and feature
    units = sorted(r["unit"] for r in rows.select("unit").distinct().collect())
    out = {}
    for u in units:
        middle = [found.get((u, i), 0.0) for i in range(len(features))]
        filled = [F.coalesce(value(f), F.lit(m)) for f, m in zip(features, middle)]
        r = rows.where(F.col("unit") == u).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(filled)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(filled)]).first()
        spread = [r[f"s{i}"] or 0.0 for i in range(len(features))]
        out[u] = (middle, [r[f"m{i}"] or 0.0 for i in range(len(features))], [s if s >= 1e-12 else 1.0 for s in spread])
    return out


def _standardised(features: list[str], standards: dict) -> list[Column]:
    value = lambda f: F.when(F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(F.col(f)) < float("inf")), F.col(f).cast("double"))
    each = lambda i, s: (F.coalesce(value(features[i]), F.lit(float(s[0][i]))) - float(s[1][i])) / float(s[2][i])
    return [F.coalesce(*[F.when(F.col("unit") == u, each(i, s)) for u, s in standards.items()], F.lit(None).cast("double")).alias(f) for i, f in enumerate(features)]


def rescored(rows: DataFrame, features: list[str] = BASE, folds: int = FOLDS, rounds: int = ROUNDS, least: int = LEAST_POSITIVES) -> DataFrame:
    """id, decoy, score, q of ``rows`` (id in the order of ties, group, decoy, intensity, hybrid, features).

    Rows without signal keep out: targets among them get q 1.  Features are
    standardised over all rows, folds go by the group; where there are no
    targets or no decoys the hybrid score ranks.
    """
    x = rows.where("intensity > 0").select("id", "decoy", F.pmod(F.col("group"), F.lit(folds)).cast("int").alias("fold"), F.coalesce("hybrid", F.lit(0.0)).alias("hybrid"), *features)
    x = cut_lineage(x)
    sides = {r["decoy"] for r in x.select("decoy").distinct().collect()}
    held = x.select("id", "decoy", F.col("hybrid").alias("score"))
    if len(sides) == 2:
        whole = x.withColumn("unit", F.lit(0))
        x = cut_lineage(whole.select("id", "decoy", "fold", "hybrid", *_standardised(features, _standards(whole, features))))
        others = F.explode(F.filter(F.array(*map(F.lit, range(folds))), lambda f: f != F.col("fold")))
        models = _learnt(x.select(others.alias("unit"), "id", "decoy", F.col("hybrid").alias("score"), *features), features, rounds, False, least)
        own = [F.when(F.col("fold") == f, m.score([F.col(c) for c in features])) for f, m in models.items()]
        score = F.coalesce(*own, F.col("hybrid"))
        held = cut_lineage(x.select("id", "decoy", F.when(F.isnan(score) | (F.abs(score) == float("inf")), F.col("hybrid")).otherwise(score).alias("score")))
    found = st.target_decoy_q(held)
    return _with_silent(rows, found)


def _with_silent(rows: DataFrame, found: DataFrame) -> DataFrame:
    silent = rows.where("not (intensity > 0) or intensity is null").select("id", "decoy", F.lit(None).cast("double").alias("score"), F.lit(1.0).alias("q"))
    return found.select("id", "decoy", "score", "q", *[c for c in ("stratum",) if c in found.columns]).unionByName(silent, allowMissingColumns=True)


def search_rescored(rows: DataFrame, mode: str = "charge_stratified", folds: int = FOLDS, rounds: int = ROUNDS, least: int = LEAST_POSITIVES, support: tuple[int, int, int] = SUPPORT) -> DataFrame:
    """id, decoy, score, q, stratum of ``rows`` as above with ``peptide`` and ``charge``: folds go by the peptide's hash.

    Charges 2, 3 and the rest are strata where the mode asks for it and every
    one of them has ``support`` in the training rows of every fold; else all
    cells are one.  Medians and spreads are those of a fold's training rows.  A
    stratum in which any fold cannot be fitted is ranked by the hybrid score.  q
    counts one decoy more, and ties as one.
    """
    features = MODES[mode]
    hybrid = F.when(F.isnan("hybrid") | (F.abs("hybrid") == float("inf")) | F.col("hybrid").isNull(), 0.0).otherwise(F.col("hybrid"))
    by_charge = F.when(F.col("charge").isin(2, 3), F.col("charge").cast("int")).otherwise(0)
    x = rows.where(~F.isnan("intensity") & (F.col("intensity") > 0)).select("id", "decoy", "peptide", by_charge.alias("stratum"), fnv1a(F.col("peptide"), folds).alias("fold"), hybrid.alias("hybrid"), *features)
    x = cut_lineage(x)
    others = F.explode(F.filter(F.array(*map(F.lit, range(folds))), lambda f: f != F.col("fold")))
    if mode.startswith("charge"):
        each = x.withColumn("other", others).groupBy("stratum", "other").agg(F.count_if(~F.col("decoy")).alias("t"), F.count_if("decoy").alias("d"), F.count_distinct("peptide").alias("p")).collect()  # a row for each fold and stratum
        strata = {r["stratum"] for r in x.select("stratum").distinct().collect()}
        enough = sum(r["t"] >= support[0] and r["d"] >= support[1] and r["p"] >= support[2] for r in each)
        if enough < folds * len(strata):
            x = x.withColumn("stratum", F.lit(-1))
    else:
        x = x.withColumn("stratum", F.lit(-1))
    unit = lambda fold: F.col("stratum") * folds + fold
    train = cut_lineage(x.withColumn("other", others).withColumn("unit", unit(F.col("other"))))
    standards = _standards(train, features)
    models = _learnt(train.select("unit", "id", "decoy", F.col("hybrid").alias("score"), *_standardised(features, standards)), features, rounds, True, least)
    x = x.withColumn("unit", unit(F.col("fold")))
    own = x.select("id", "decoy", "stratum", "unit", "hybrid", *_standardised(features, standards))
    score = F.coalesce(*[F.when(F.col("unit") == u, m.score([F.col(c) for c in features])) for u, m in models.items()], F.lit(float("nan")))
    own = cut_lineage(own.select("id", "decoy", "stratum", "hybrid", score.alias("score")))
    broken = [r["stratum"] for r in own.where(F.isnan("score") | (F.abs("score") == float("inf"))).select("stratum").distinct().collect()]  # strata
    held = own.select("id", "decoy", "stratum", F.when(F.col("stratum").isin(broken), F.col("hybrid")).otherwise(F.col("score")).alias("score") if broken else F.col("score"))
    found = st.target_decoy_q(held, True, ("stratum",))
    return _with_silent(rows, found)
