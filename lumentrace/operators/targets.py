"""Targets from identifications: donors, rejection, charge expansion, and labels of their cells.

``ids`` rows are run, peptide, charge, mass, rt, q, im (null where unknown), row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.operators.isotopes import PROTON


def rt_supported(ids: DataFrame, ranges: DataFrame, share: float = 0.05) -> DataFrame:
    """``ids`` with ``supported``: in the one time window (``share`` of the run's extent) that holds most of the peptide's rows in a run.

    That window must be the only such one, and hold all rows or a strict
    majority of two or more; rows outside the run's extent are not supported.
    """
    rows = ids.join(F.broadcast(ranges.select("run", F.col("low").alias("__low"), F.col("high").alias("__high"))), "run")  # a row for each run
    keys = ["run", "peptide", "charge", "__width"]
    rows = rows.withColumn("__width", (F.col("__high") - F.col("__low")) * share)
    each = rows.groupBy(*keys, "__low", "__high").agg(F.sort_array(F.collect_list(F.struct("rt", "row"))).alias("all"))  # identifications of one peptide in a run
    counts = F.transform("all", lambda a: F.size(F.filter("all", lambda b: (b >= a) & (b.rt <= a.rt + F.col("__width")))))
    each = each.withColumn("counts", counts).withColumn("most", F.array_max("counts"))
    alone = F.size(F.filter("counts", lambda c: c == F.col("most"))) == 1
    enough = (F.col("most") == F.size("all")) | ((F.col("most") >= 2) & (2 * F.col("most") > F.size("all")))
    first = F.array_position("counts", F.col("most")).cast("int")
    each = each.select("run", "peptide", "charge", "__low", "__high", F.when(alone & enough, F.slice("all", first, F.col("most"))).otherwise(F.slice("all", 1, 0)).alias("good"))
    good = each.select("run", "peptide", "charge", "__low", "__high", F.explode("good").alias("g")).where((F.col("g.rt") >= F.col("__low")) & (F.col("g.rt") <= F.col("__high")))
    good = good.select("run", F.col("g.row").alias("row"), F.lit(True).alias("supported"))
    return ids.join(good, ["run", "row"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def donors(ids: DataFrame) -> DataFrame:
    """The best row of each peptide, charge and run: least q, then time, mass, mobility, charge and row."""
    best = Window.partitionBy("run", "peptide", "charge").orderBy("q", "rt", "mass", F.col("im").asc_nulls_last(), "charge", "row")
    return ids.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def build(ids: DataFrame, mass_ppm: float = 10.0, rt_span: float = 1.0, im_span: float = 0.05) -> DataFrame:
    """peptide, charge, mass, mz, n_runs, seed (the best donor), donors (one a run), reason (null where the target stands).

    A peptide and charge whose masses differ too much, or whose times or
    mobilities spread too far within a run, is rejected for that reason.
    """
    within = ids.groupBy("peptide", "charge", "run").agg((F.max("rt") - F.min("rt")).alias("rt_span"), (F.max("im") - F.min("im")).alias("im_span"))
    spans = within.groupBy("peptide", "charge").agg(F.max("rt_span").alias("rt_span"), F.max("im_span").alias("im_span"))
    masses = ids.groupBy("peptide", "charge").agg(((F.max("mass") - F.min("mass")) / F.min("mass") * 1e6).alias("mass_span"))
    found = donors(ids).groupBy("peptide", "charge").agg(
        F.count("*").alias("n_runs"), F.min(F.struct("q", "rt", "mass", "run", "row", "im")).alias("seed"), F.sort_array(F.collect_list(F.struct("run", "rt", "q", "mass", "im"))).alias("donors"),  # a row for each run
    )
    rows = found.join(spans, ["peptide", "charge"]).join(masses, ["peptide", "charge"])
    reason = F.when(F.col("mass_span") > mass_ppm, "inconsistent mass").when(F.col("rt_span") > rt_span, "ambiguous time").when(F.col("im_span") > im_span, "ambiguous mobility")
    return rows.select("peptide", "charge", F.col("seed.mass").alias("mass"), (F.col("seed.mass") / F.col("charge") + PROTON).alias("mz"), "n_runs", "seed", "donors", reason.alias("reason"))


def expanded(targets: DataFrame, observed: DataFrame, charges: tuple[int, int] = (2, 4)) -> DataFrame:
    """``targets`` that stand and, for each peptide, the other charges whose m/z lies within the runs' observed m/z.

    ``observed`` has run, low, high.  ``inferred`` marks added charges,
    ``eligible_runs`` the runs that can hold them; a peptide's best target is their donor.
    """
    stand = targets.where("reason is null")
    best = stand.groupBy("peptide").agg(F.min_by(F.struct("mass", "seed", "n_runs"), F.struct("seed.q", "charge")).alias("b"), F.collect_set("charge").alias("has"))
    runs = observed.agg(F.collect_list(F.struct("run", "low", "high")).alias("runs"))  # a row for each run
    added = best.withColumn("charge", F.explode(F.sequence(*map(F.lit, charges)))).where(~F.array_contains("has", F.col("charge"))).join(F.broadcast(runs))
    added = added.withColumn("mz", F.col("b.mass") / F.col("charge") + PROTON)
    can = F.transform(F.filter("runs", lambda r: (r.low <= F.col("mz")) & (F.col("mz") <= r.high)), lambda r: r.run)
    added = added.select("peptide", "charge", F.col("b.mass").alias("mass"), "mz", F.lit(0).cast("long").alias("n_runs"), F.col("b.seed").alias("seed"), F.lit(True).alias("inferred"), can.alias("eligible_runs")).where(F.size("eligible_runs") > 0)
    every = stand.join(F.broadcast(runs)).select("peptide", "charge", "mass", "mz", "n_runs", "seed", F.lit(False).alias("inferred"), F.transform("runs", lambda r: r.run).alias("eligible_runs"))
    return every.unionByName(added)


def eligible_runs(pairs: DataFrame, min_anchors: int = 20) -> DataFrame:
    """run: those with enough anchors that count (two at least) for identifications to be carried over."""
    return pairs.where("active").groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= max(min_anchors, 2)).select("run")


def cell_plan(targets: DataFrame, ids: DataFrame, runs: DataFrame, aligned: DataFrame, transfer: bool = True) -> DataFrame:
    """peptide, charge, run, direct, inferred, attempted of each target in each run."""
    here = donors(ids).select("peptide", "charge", "run", F.lit(True).alias("direct"))
    rows = targets.join(F.broadcast(runs.select("run"))).join(here, ["peptide", "charge", "run"], "left").join(F.broadcast(aligned.select("run", F.lit(True).alias("aligned"))), "run", "left")
    direct = F.coalesce("direct", F.lit(False))
    carried = F.lit(transfer) & F.coalesce("aligned", F.lit(False)) & F.array_contains("eligible_runs", F.col("run"))
    return rows.select("peptide", "charge", "run", direct.alias("direct"), (~direct & F.col("inferred")).alias("inferred"), (direct | carried).alias("attempted"))


def labelled(cells: DataFrame, most_q: float = 0.05) -> DataFrame:
    """``cells`` (attempted, direct, inferred, intensity, q) with evidence and status."""
    evidence = F.when(F.col("direct"), "direct").when(F.col("inferred"), "inferred").otherwise("transferred")
    status = F.when(~F.col("attempted"), "not attempted").when(F.coalesce("intensity", F.lit(0.0)) <= 0, "no signal").when(F.coalesce("q", F.lit(1.0)) > most_q, "above q").otherwise("quantified")
    return cells.withColumns({"evidence": evidence, "status": status})
