"""Quantities of identified peptides over runs: from identifications, features and hills to a long table, a matrix and rejections.

``ids`` as for ``targets``: run, peptide, charge, mass, rt, q, im (null where
unknown), row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.functions.lineage import cut_lineage
from lumentrace.operators import drivers, ownership, quantification, rescoring, targets
from lumentrace.operators import alignment as al
from lumentrace.sources import bundles

#: Evidence of a cell, and the class in which its q is ranked.
CLASSES = {"direct_ms2": "direct", "inferred_charge": "anchored", "mbr_inferred_charge": "transferred", "mbr": "transferred"}
KEYS = ["peptide", "charge", "run"]


def plan(found: DataFrame, ids: DataFrame, runs: DataFrame, aligned: DataFrame, transfer: bool = True) -> DataFrame:
    """A row for each target of ``found`` (of ``targets.expanded``) and run: evidence, attempted, anchor (rt, im, q, row in that run), seed.

    A target is direct where its peptide and charge were identified, anchored
    where it is an added charge and the peptide was identified at another one;
    else it is carried over from its seed's run, to aligned runs whose m/z reach it.
    """
    best = targets.donors(ids)
    held = F.struct("rt", "im", "q", "row", "charge")
    direct = best.select(*KEYS, held.alias("direct"))
    first = Window.partitionBy("peptide", "run").orderBy("q", "charge", "row")
    native = best.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("peptide", "run", held.alias("native"))
    rows = found.join(F.broadcast(runs.select("run"))).join(F.broadcast(aligned.select("run", F.lit(True).alias("__aligned"))), "run", "left")  # a row for each run
    rows = rows.join(direct, KEYS, "left").join(native, ["peptide", "run"], "left")
    is_direct = F.col("direct").isNotNull()
    is_anchored = ~is_direct & F.col("inferred") & F.col("native").isNotNull()
    carried = F.lit(transfer) & F.coalesce("__aligned", F.lit(False)) & F.array_contains("eligible_runs", F.col("run"))
    evidence = F.when(is_direct, "direct_ms2").when(is_anchored, "inferred_charge").when(F.col("inferred"), "mbr_inferred_charge").otherwise("mbr")
    anchor = F.when(is_direct, F.col("direct")).when(is_anchored, F.col("native"))
    return rows.select(*KEYS, "mass", "mz", "seed", evidence.alias("evidence"), (is_direct | is_anchored | carried).alias("attempted"), anchor.alias("anchor"), (F.col("inferred") & ~is_direct).alias("inferred"))


def cells_of(planned: DataFrame, places: DataFrame, hills: DataFrame, o: drivers.Study = drivers.Study()) -> DataFrame:
    """Cells of what ``planned`` attempts, at the anchor's time and mobility where there is one, else where the seed's run puts them."""
    seeds = planned.select("peptide", "charge", "mass", "mz", "seed").distinct()
    seeds = seeds.select("peptide", "charge", "mass", F.col("mz").alias("own_mz"), F.col("seed.run").alias("run"), F.col("seed.rt").alias("rt"), F.lit(1.0).alias("mz"), F.coalesce("seed.im", F.lit(0.0)).alias("im"))
    asked = al.to_reference(seeds, places).select(F.xxhash64("peptide", "charge").alias("group"), "peptide", "charge", "mass", F.col("own_mz").alias("ref_mz"), "ref_rt", "ref_im")
    tried = planned.where("attempted").select(*KEYS, "evidence", "inferred", F.col("anchor.rt").alias("anchor_rt"), F.col("anchor.im").alias("anchor_im"))
    each = al.to_runs(asked, places).join(tried, KEYS)
    each = each.withColumns({"rt": F.coalesce("anchor_rt", "rt"), "im": F.coalesce("anchor_im", "im")}).drop("anchor_rt", "anchor_im")
    return drivers.with_decoys(each, hills, o)


def ranked(cells: DataFrame, o: drivers.Study = drivers.Study(), mode: str = "charge_stratified") -> DataFrame:
    """``cells`` rescored by peptide folds, with q within each class of evidence; cells without signal have 1."""
    named = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    rows = cells.withColumns({"id": F.xxhash64(*KEYS, "decoy"), "class": named[F.col("evidence")]})
    scored = rescoring.search_rescored(rescoring.cell_features(rows, mode), mode, rounds=o.rounds, least=o.least_positives)
    scored = cut_lineage(rows.select("id", F.col("class").alias("evidence")).join(scored.select("id", "decoy", "score"), "id"))
    classes = sorted(set(CLASSES.values()))
    q = quantification.q_by_class(scored.where("score is not null"), classes).select("id", "score", "q")
    return rows.join(q, "id", "left").withColumn("q", F.coalesce("q", F.lit(1.0))).drop("id")


def labelled(planned: DataFrame, measured: DataFrame, most_q: float = 0.05, gate_transfers_only: bool = False, scored: bool = True) -> DataFrame:
    """The long table: a row for each target and run with its evidence, status, intensity, what is accepted of it, and where it comes from.

    ``measured`` has peptide, charge, run, intensity and q of target cells; a
    cell that is not there has no signal.  With ``gate_transfers_only`` direct
    cells pass whatever their q; without ``scored`` nothing is accepted.
    """
    rows = planned.join(measured.select(*KEYS, "intensity", "q"), KEYS, "left").withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))
    direct = F.col("evidence") == "direct_ms2"
    sound = F.col("q").isNotNull() & ~F.isnan("q")
    free = direct if gate_transfers_only else F.lit(False)
    passed = free | F.coalesce(sound & (F.col("q") <= most_q), F.lit(False))
    status = F.when(~F.col("attempted"), "not_attempted").when(F.col("intensity") <= 0, "no_signal").when(~F.lit(scored), "unscored").when(passed, "accepted").otherwise("rejected")
    rows = rows.withColumn("status", status)
    return rows.select(
        *KEYS, "evidence", "status", "intensity", F.when(F.col("status") == "accepted", F.col("intensity")).otherwise(0.0).alias("accepted_intensity"),
        F.when(F.col("attempted") & F.lit(scored) & sound, F.col("q")).alias("extraction_q"), F.when(direct, F.col("anchor.q")).alias("direct_q"),
        F.col("seed.run").alias("seed_run"), F.col("seed.q").alias("seed_q"), F.when(direct, F.col("anchor.row")).alias("direct_row"), F.col("seed.row").alias("seed_row"),
    )


def matrix(long: DataFrame, runs: list[str]) -> DataFrame:
    """peptide, charge and a column of accepted intensities for each run, 0 where there is none."""
    return long.groupBy("peptide", "charge").pivot("run", runs).agg(F.first("accepted_intensity")).na.fill(0.0)


def rejections(built: DataFrame) -> DataFrame:
    """peptide, charge, reason of the targets that do not stand."""
    return built.where("reason is not null").select("peptide", "charge", "reason")


def quantify(ids: DataFrame, features: DataFrame, hills: DataFrame, reference: str, o: drivers.Study = drivers.Study(), charges: tuple[int, int] | None = (2, 4), transfer: bool = True, min_anchors: int = 20, mode: str = "charge_stratified", gate_transfers_only: bool = False) -> dict[str, DataFrame]:
    """peptide_quant, peptide_intensity_matrix, search_rejections, and the cells behind them, of ``ids`` in all runs of ``features`` and ``hills``."""
    features, hills, ids = cut_lineage(features), cut_lineage(hills), cut_lineage(ids)
    places, active = drivers.placed(features, reference, o)
    aligned = targets.eligible_runs(active, min_anchors).union(places.where("is_reference").select("run"))
    built = cut_lineage(targets.build(ids))
    observed = features.groupBy("run").agg(F.min("mz").alias("low"), F.max("mz").alias("high"))
    # Without a range of charges none is added.
    found = targets.expanded(built, observed, charges) if charges else targets.expanded(built, observed, (1, 1)).where("not inferred")
    planned = cut_lineage(plan(found, ids, observed, aligned, transfer))
    cells = cut_lineage(ownership.two_passes(cells_of(planned, places, hills, o), hills, o.extraction))
    cells = cut_lineage(ranked(cells, o, mode))
    long = labelled(planned, cells.where("not decoy"), o.most_q, gate_transfers_only)
    runs = sorted(r["run"] for r in observed.select("run").collect())  # a row for each run
    return {"peptide_quant": long, "peptide_intensity_matrix": matrix(long, runs), "search_rejections": rejections(built), "cells": cells}


def write(found: dict[str, DataFrame], folder: str, sources: dict[str, str], most_q: float = 0.05, gate_transfers_only: bool = False) -> dict:
    """Writes ``quantify``'s three tables as a bundle: the manifest comes last, and not where a source changed."""
    tables = {k: v for k, v in found.items() if k != "cells"}
    more = {"most_q": most_q, "gate_transfers_only": gate_transfers_only, "confidence": "identification q-values are imported; extraction q-values rank within each class of evidence and bound no transfer error"}
    return bundles.write(folder, tables, sources, more)
