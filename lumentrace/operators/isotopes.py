"""Isotope patterns and their scores, in array functions.

A pattern is the share of a molecule's first ``SLOTS`` isotopes.  Elements'
patterns for each number of atoms come from repeated convolution, once, as a
small table (``ELEMENTS``: 1,365 rows whatever the input) that is broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.functions.binding import bound
from lumentrace.operators.statistics import RESIDUE, RESIDUE_MASS

SLOTS = 10
PROTON = 1.00727646688
NEUTRON = 1.003354835
#: Shares of each element's isotopes by added neutrons, and the most atoms that are told apart: fixed values of the model.
ISOTOPES = {
    "c": ([0.9893, 0.0107], 300),
    "h": ([0.999885, 0.000115], 500),
    "n": ([0.99632, 0.00368], 220),
    "o": ([0.99757, 0.00038, 0.00205], 320),
    "s": ([0.9499, 0.0075, 0.0425, 0.0, 0.0001], 20),
}


def element_tables() -> dict[str, np.ndarray]:
    """Patterns of 0 atoms up to the most of each element, by repeated convolution."""
    tables = {}
    for element, (single, most) in ISOTOPES.items():
        rows = np.zeros((most + 1, SLOTS))
        rows[0, 0] = 1.0
        for n in range(1, most + 1):
            rows[n] = np.convolve(rows[n - 1], single)[:SLOTS]
        tables[element] = rows
    return tables


def elements(spark: SparkSession) -> DataFrame:
    """element, atoms, pattern."""
    rows = [(e, n, row.tolist()) for e, table in element_tables().items() for n, row in enumerate(table)]
    return spark.createDataFrame(rows, "element string, atoms int, pattern array<double>")


def neutral_mass(mz, charge, polarity: int = 1) -> Column:
    return mz * charge - polarity * charge * F.lit(PROTON)


def counts(mass, ceil_sulfur: bool = False) -> dict[str, Column]:
    """Atoms of a neutral mass, rounded half up; sulfur rounded up if asked."""
    scale = F.greatest(F.lit(0.0), mass) / F.lit(RESIDUE_MASS)
    out = {e.lower(): F.floor(F.lit(x) * scale + 0.5).cast("int") for e, x in RESIDUE.items()}
    if ceil_sulfur:
        out["s"] = F.ceil(F.lit(RESIDUE["S"]) * scale).cast("int")
    return out


def sulfur_counts(mass, offsets: list[int]) -> Column:
    """Numbers of sulfur atoms to try: the rounded-up one plus each offset, none below 0, each once in order."""
    up = counts(mass, ceil_sulfur=True)["s"]
    return F.array_distinct(F.transform(F.array(*map(F.lit, offsets)).cast("array<int>"), lambda o: F.greatest(F.lit(0), up + o)))


def convolved(a, b) -> Column:
    """The first SLOTS terms of the product of two patterns."""
    term = lambda x, k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, i: s + F.get(x.a, i) * F.get(x.b, k - i))
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda x: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: term(x, k)))


def _total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _unit(a) -> Column:
    share = lambda x: F.when(x.total > 0, F.transform(x.a, lambda v: v / x.total)).otherwise(x.a)
    return bound(a, lambda a: bound(F.struct(a.alias("a"), _total(a).alias("total")), share))


def with_patterns(rows: DataFrame, mass: str, offsets: list[int] | None = None) -> DataFrame:
    """``rows`` with ``pattern`` (of the rounded counts) and, for sulfur ``offsets``, ``templates``: (sulfur, pattern) of each number to try."""
    table = elements(rows.sparkSession)
    out = rows
    held = []
    for e, (_, most) in ISOTOPES.items():
        one = F.broadcast(table.where(F.col("element") == e).select(F.col("atoms").alias(f"__n_{e}"), F.col("pattern").alias(f"__{e}")))
        if e != "s":
            out = out.withColumn(f"__n_{e}", F.least(F.lit(most), counts(F.col(mass))[e])).join(one, f"__n_{e}", "left")
            held += [f"__n_{e}", f"__{e}"]
    sulfur = F.array(*[F.array(*map(F.lit, row.tolist())) for row in element_tables()["s"]])
    most = ISOTOPES["s"][1]
    for k, e in enumerate("hno"):
        out = out.withColumn(f"__b{k}", convolved(F.col("__c") if k == 0 else F.col(f"__b{k - 1}"), F.col(f"__{e}")))
    whole = lambda n: _unit(convolved(F.col("__b2"), F.get(sulfur, F.least(F.lit(most), n))))
    out = out.withColumn("pattern", whole(counts(F.col(mass))["s"]))
    if offsets is not None:
        tried = sulfur_counts(F.col(mass), offsets) if offsets else F.array(counts(F.col(mass))["s"])
        out = out.withColumn("templates", F.transform(tried, lambda n: F.struct(n.alias("sulfur"), whole(n).alias("pattern"))))
    return out.drop(*held, "__b0", "__b1", "__b2")


def affinity(observed, template) -> Column:
    """Bhattacharyya coefficient of the observed isotopes and as many of the template, times the template's share in those."""
    k = F.least(F.lit(SLOTS), F.size(observed))
    head = lambda a: F.slice(a, 1, F.greatest(F.lit(1), k))

    def score(x):
        p, q = _total(x.o), _total(x.t)
        both = _total(F.zip_with(x.o, x.t, lambda a, b: F.sqrt(a * b))) / F.sqrt(p * q)
        return F.when((p <= 0) | (q <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), both * q)))

    return F.when(F.size(observed) == 0, 0.0).otherwise(bound(F.struct(head(observed).alias("o"), head(template).alias("t")), score))


def best_affinity(observed, templates) -> Column:
    """(score, sulfur) of the best template; the first of equally good ones, and the first where none scores."""
    each = F.transform(templates, lambda t: F.struct(affinity(observed, t.pattern).alias("score"), t.sulfur.alias("sulfur")))
    return bound(each, lambda each: F.aggregate(each, F.get(each, F.lit(0)), lambda best, x: F.when(x.score > best.score, x).otherwise(best)))


def score_features(features: DataFrame, offsets: list[int] | None = None, search: bool = False, zero_bonus: float = 0.0, floor: float = 0.0) -> DataFrame:
    """Charged ``features`` (mz, charge, observed: isotope intensities at the apex, cosine_score) with their scores.

    neutron_offset (of -1, 0, 1 if ``search``; 0 gets ``zero_bonus`` and wins
    below ``floor``), isotope_score, combined_score, theoretical_pattern.
    """
    rows = features.where("charge > 0").withColumn("__mass", neutral_mass(F.col("mz"), F.col("charge")))
    rows = with_patterns(rows, "__mass", offsets or [])
    k = F.least(F.lit(SLOTS), F.size("observed"))
    moved = lambda o: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), k - 1)), lambda j: F.when((j + o >= 0) & (j + o < k), F.get("observed", j + o)).otherwise(0.0))
    tries = [-1, 0, 1] if search else [0]
    scores = F.array(*[F.struct(F.lit(o).alias("o"), best_affinity(moved(o), F.col("templates")).score.alias("score")) for o in tries])
    rows = rows.withColumn("__tries", scores)
    value = lambda t: t.score + F.when(t.o == 0, zero_bonus).otherwise(0.0)
    best = F.aggregate("__tries", F.get("__tries", F.lit(0)), lambda b, t: F.when(value(t) > value(b), t).otherwise(b))
    rows = rows.withColumn("__best", best)
    low = value(F.col("__best")) < floor
    at_zero = best_affinity(F.col("observed"), F.col("templates")).score
    rows = rows.withColumns({
        "neutron_offset": F.when(low, 0).otherwise(F.col("__best.o")),
        "isotope_score": F.when(low, at_zero).otherwise(F.col("__best.score")),
        "theoretical_pattern": _unit(F.slice("pattern", 1, F.greatest(F.lit(1), k))),
    })
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine_score")))
    return rows.withColumn("combined_score", F.col("isotope_score") * cosine).drop("__mass", "__tries", "__best", "templates", "pattern")


def retained(scored: DataFrame, isotope: float = 0.0, cosine: float = 0.0, combined: float = 0.0) -> DataFrame:
    return scored.where((F.col("isotope_score") >= isotope) & (F.least(F.lit(1.0), F.col("cosine_score")) >= cosine) & (F.col("combined_score") >= combined))
