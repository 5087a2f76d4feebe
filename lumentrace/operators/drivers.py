"""From hills to features, and from features and hills of many runs to quantities, each in one call."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.functions.lineage import cut_lineage
from lumentrace.operators import alignment, chains, consensus, isotopes, ownership, quantification, rescoring
from lumentrace.operators import statistics as st


def find_features(hills: DataFrame, o: chains.Chains = chains.Chains(), recalibrate: bool = True, least: int = 50, sulfur: tuple[int, ...] = (-1, 0, 1)) -> tuple[DataFrame, DataFrame | None]:
    """Scored features of numbered ``hills``, and the surface that they were found with (None where there was none).

    With ``recalibrate`` features are found twice: the spacings of the first
    pass give each run's channel a surface, the second takes targets and
    tolerances from it.  A channel of fewer than ``least`` spacings goes without.
    Shuffled scans would bend the surface: leave it off for decoys.
    """
    hills = cut_lineage(hills)  # read in every round

    def once(surface: DataFrame | None) -> DataFrame:
        chosen = chains.resolved(chains.gated(chains.with_evidence(chains.candidates(hills, o, surface), o), hills, o))
        return cut_lineage(chains.features(chosen, hills, o.min_overlap))

    found, surface = once(None), None
    if recalibrate:
        surface = cut_lineage(chains.recalibration(chains.spacing_residuals(found, hills), least))
        if surface.isEmpty():
            surface = None
        else:
            found = once(surface)
    return isotopes.score_features(found, list(sulfur)), surface


@dataclass(frozen=True)
class Study:
    """Settings of a quantification over runs; shares are of a run's extent in time."""

    warping: alignment.Warping = field(default_factory=alignment.Warping)
    grouping: consensus.Grouping = field(default_factory=consensus.Grouping)
    extraction: quantification.Extraction = field(default_factory=quantification.Extraction)
    window_share: float = 0.005
    decoy_da: float = 11.0
    decoy_share: float = 0.01
    #: Whether each decoy has the template of its own mass.
    own_template: bool = False
    adaptive: bool = True
    most_q: float = 0.05
    #: Settings of the rescoring: rounds, and how many positives it learns from at least.
    rounds: int = rescoring.ROUNDS
    least_positives: int = rescoring.LEAST_POSITIVES


def cells_of(groups: DataFrame, places: DataFrame, hills: DataFrame, o: Study = Study()) -> DataFrame:
    """A target and a decoy cell of each group (group, charge, mass, ref_mz, ref_rt, ref_im) in each run.

    Windows and the decoys' shift in time are shares of the run's extent; the
    number of columns follows the run's scan spacing.
    """
    return with_decoys(alignment.to_runs(groups, places), hills, o)


def with_decoys(each: DataFrame, hills: DataFrame, o: Study = Study()) -> DataFrame:
    """Cells of places in runs (group, charge, mass, run, rt, mz, im, low, high): windows, columns, templates, and a decoy of each."""
    each = each.withColumn("half_window", o.window_share * (F.col("high") - F.col("low")))
    each = each.withColumn("decoy", F.explode(F.array(F.lit(False), F.lit(True))))
    off = F.col("decoy").cast("int")
    each = each.withColumns({"rt": F.col("rt") - off * o.decoy_share * (F.col("high") - F.col("low")), "mz": F.col("mz") + off * o.decoy_da / F.col("charge"), "cell_id": F.col("group")})
    if o.adaptive:
        # Windows differ by run, so columns are counted for a window of one and scaled.
        spacing = quantification.scan_spacing(hills)
        wanted = F.round(2 * F.col("half_window") / (quantification.SCANS_A_COLUMN * F.col("spacing")))
        columns = F.coalesce(F.greatest(F.lit(quantification.LEAST_COLUMNS), F.least(F.lit(o.extraction.columns), wanted)), F.lit(o.extraction.columns)).cast("int")
        each = each.join(F.broadcast(spacing), "run", "left").withColumn("columns", columns).drop("spacing")
    mass = F.col("mass") + (off * o.decoy_da if o.own_template else F.lit(0.0))
    each = isotopes.with_patterns(each.withColumn("template_mass", mass), "template_mass").withColumnRenamed("pattern", "template")
    return each.drop("low", "high", "template_mass")


def placed(features: DataFrame, reference: str, o: Study = Study()) -> tuple[DataFrame, DataFrame]:
    """Each run's place against the reference (``alignment.run_places``), and the anchors that it comes from."""
    pairs = cut_lineage(alignment.anchors(alignment.anchor_candidates(features, reference, o.warping)))
    lines, active = alignment.warps(pairs, o.warping)
    places = cut_lineage(alignment.run_places(features, reference, cut_lineage(lines), alignment.drift_lines(pairs)))
    return places, active


def quantify(features: DataFrame, hills: DataFrame, reference: str, o: Study = Study()) -> dict[str, DataFrame]:
    """groups, cells and factors of ``features`` (run, feature_id, mz, charge, rt, im, score) and ``hills`` (run, hill_id, ...) of all runs.

    Runs are aligned to the reference, features grouped and gated against
    permuted copies, every group's cell extracted from every run with each
    sample used once, rescored against decoys, and scaled by run.
    """
    features, hills = cut_lineage(features), cut_lineage(hills)  # read in every step
    places, _ = placed(features, reference, o)
    rows = alignment.to_reference(features, places)
    known = consensus.projected(rows.drop("im").withColumnRenamed("ref_im", "im"))
    groups = cut_lineage(consensus.gated(consensus.confident(known, o.grouping), o.grouping))
    numbered = groups.withColumns({"group": F.xxhash64("charge", "group_id"), "ref_mz": F.col("mass") / F.col("charge") + isotopes.PROTON})
    asked = numbered.select("group", "charge", "mass", "ref_mz", F.col("rt").alias("ref_rt"), F.col("im").alias("ref_im"))
    cells = cut_lineage(ownership.two_passes(cells_of(asked, places, hills, o), hills, o.extraction))
    ids = cells.withColumn("id", F.xxhash64("group", "run", "decoy"))
    scored = rescoring.rescored(rescoring.cell_features(ids), rounds=o.rounds, least=o.least_positives)
    cells = ids.join(scored.select("id", "score", "q"), "id").drop("id")
    targets = cells.where("not decoy").select(F.col("group").alias("row"), "run", "intensity")
    factors = cut_lineage(st.median_ratio(targets))
    return {"groups": numbered, "cells": st.normalised(cells, factors), "factors": factors}


#: Columns in front of a matrix's runs.
FRONT = ["group", "mass", "ref_mz", "charge", "ref_rt", "ref_im", "score", "n_runs"]


def matrices(found: dict[str, DataFrame], runs: list[str], most_q: float = 0.05) -> dict[str, DataFrame]:
    """intensity, q and decoy matrices with the groups' columns in front, and ``consensus`` with n_detected: the runs with signal at ``most_q`` or less."""
    front = found["groups"].select("group", "mass", "ref_mz", "charge", F.col("rt").alias("ref_rt"), F.col("im").alias("ref_im"), "score", "n_runs", "group_score", F.col("q").alias("group_q"))
    wide = quantification.matrices(found["cells"], runs)
    out = {name: front.select(*FRONT).join(table, "group") for name, table in wide.items()}
    seen = found["cells"].where("not decoy").groupBy("group").agg(F.count_if((F.col("intensity") > 0) & (F.col("q") <= most_q)).alias("n_detected"))
    return out | {"consensus": front.join(seen, "group")}
