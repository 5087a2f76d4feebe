"""Isotope chains: hills one neutron apart that elute together.

``hills`` rows are run, channel, hill_id, mz, rt, im, scan_start, scan_end,
intensity_max, profile.  Neighbours are found by an equi-join on m/z bins as
wide as the tolerance and slices of the scan axis; chains of all seeds and
charges grow side by side, one join for each isotope; claims are settled in
rounds in which every chain that beats all its rivals is accepted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.functions.binding import bound
from lumentrace.functions.lineage import cut_lineage
from lumentrace.operators.isotopes import NEUTRON, best_affinity, neutral_mass, with_patterns
from lumentrace.operators.statistics import noise_floor, recalibration_surface, surface_bin
from lumentrace.operators.traces import elution_cosine

KEYS = ["run", "channel"]


@dataclass(frozen=True)
class Chains:
    ppm: float = 10.0
    charges: tuple[int, int] = (1, 5)
    max_isotopes: int = 6
    min_cosine: float = 0.4
    min_step_ratio: float = 0.01
    max_log2_ratio: float = 1.5
    min_overlap: int = 3
    #: Mobility tolerance; infinite where mobility is not used.
    im_tolerance: float = math.inf
    im_relative: bool = False
    #: Whether the cosine is taken against the seed (else against the hill before).
    seed_cosine: bool = True
    ratio_sigma: float = 0.75
    cosine_shape: float = 2.0
    #: Spread of the ratio of unrelated hills, in log2.
    noise_sigma: float = 2.0
    sulfur_offsets: tuple[int, ...] = ()
    #: Whether a chain ends where its template puts the next isotope below the channel's noise floor.
    predicted_intensity: bool = False
    #: Least isotope score of a prefix that may claim its hills; 0 lets all.
    min_isotope_score: float = 0.0


def _bin(mz, ppm: float):
    return F.floor(F.log(mz) / math.log1p(ppm * 1e-6))


def neighbours(asked: DataFrame, hills: DataFrame, ppm: float, min_overlap: int = 1, min_ratio: float = 0.0, im_tolerance: float = math.inf, im_relative: bool = False, scans_a_slice: int = 64) -> DataFrame:
    """``asked`` with the struct ``hill`` of each hill within reach of its ``target``.

    ``asked`` has run, channel, target (m/z), tolerance (absolute, ``ppm`` at
    most), ref_start, ref_end (scans of a hill that must be overlapped), ref_im,
    ref_intensity, and taken (ids that do not count).
    """
    slices = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / scans_a_slice), F.floor(F.col(b) / scans_a_slice)))
    names = ["hill_id", "mz", "rt", "im", "scan_start", "scan_end", "intensity_max", "profile"]
    right = hills.select(*[F.col(c).alias(f"__{c}") for c in KEYS], F.struct(*names).alias("hill"), _bin(F.col("mz"), ppm).alias("__bin"), slices("scan_start", "scan_end").alias("__slice"))
    left = asked.withColumn("__at", _bin(F.col("target"), ppm)).withColumn("__bin", F.explode(F.array(F.col("__at") - 1, F.col("__at"), F.col("__at") + 1))).withColumn("__slice", slices("ref_start", "ref_end"))
    right = right.withColumnsRenamed({"__bin": "__bin_", "__slice": "__slice_"})
    same = F.col("run").eqNullSafe(F.col("__run")) & F.col("channel").eqNullSafe(F.col("__channel")) & (F.col("__bin") == F.col("__bin_")) & (F.col("__slice") == F.col("__slice_"))
    h = F.col("hill")
    start = F.greatest("ref_start", h.scan_start)
    shared = F.least("ref_end", h.scan_end) - start + 1
    # A pair counts in the first slice that both are in.
    near = (F.abs(h.mz - F.col("target")) <= F.col("tolerance")) & (F.col("__slice") == F.floor(start / scans_a_slice)) & (shared >= min_overlap)
    near = near & (h.intensity_max >= min_ratio * F.col("ref_intensity")) & ~F.array_contains("taken", h.hill_id)
    if math.isfinite(im_tolerance):
        reach = im_tolerance * F.greatest(h.im, F.col("ref_im")) if im_relative else F.lit(im_tolerance)
        near = near & ((h.im == 0) | (F.col("ref_im") == 0) | (F.abs(h.im - F.col("ref_im")) <= reach))
    return left.join(right, same).where(near).drop("__at", "__bin", "__slice", "__run", "__channel", "__bin_", "__slice_")


def candidates(hills: DataFrame, o: Chains = Chains(), surface: DataFrame | None = None, sigma_times: float = 3.0, floor_ppm: float = 2.0) -> DataFrame:
    """run, channel, seed, charge, seed_mz, members: chains of two hills or more, grown from every hill at every charge.

    With a recalibration ``surface`` targets move by its offset there, and the
    tolerance is ``sigma_times`` its spread at the seed, from ``floor_ppm`` up to ``ppm``.
    """
    member = lambda h, cosine: F.struct(h["hill_id"].alias("hill_id"), h["mz"].alias("mz"), h["intensity_max"].alias("intensity"), cosine.alias("cosine"))
    columns = ["hill_id", "mz", "rt", "im", "scan_start", "scan_end", "intensity_max", "profile"]
    seeds = hills.select(*KEYS, F.struct(*columns).alias("seed"))
    if surface is not None:
        at = looked_up(seeds.select("*", F.col("seed.mz").alias("mz"), F.col("seed.rt").alias("rt")), surface)
        seeds = at.select(*KEYS, "seed", F.greatest(F.lit(min(floor_ppm, o.ppm)), F.least(F.lit(o.ppm), sigma_times * F.col("spread"))).alias("seed_ppm"))
    else:
        seeds = seeds.withColumn("seed_ppm", F.lit(o.ppm))
    seeds = seeds.withColumn("charge", F.explode(F.sequence(F.lit(o.charges[0]), F.lit(o.charges[1]))))
    if o.predicted_intensity:
        # A whole channel's floor, in a row each; the template is that of the seed at each charge.
        floors = noise_floor(hills.select(unit().alias("run"), F.col("intensity_max").alias("apex"))).withColumnsRenamed({"run": "unit", "floor": "seed_floor"})
        seeds = seeds.withColumn("unit", unit()).join(F.broadcast(floors), "unit").drop("unit")
        seeds = with_patterns(seeds.withColumn("mass", neutral_mass(F.col("seed.mz"), F.col("charge"))), "mass").drop("mass")
    growing = seeds.withColumns({"last": F.col("seed"), "members": F.array(member({c: F.col(f"seed.{c}") for c in columns}, F.lit(1.0)))})
    grown = None
    for k in range(1, o.max_isotopes + 1):
        target = F.col("seed.mz") + k * NEUTRON / F.col("charge")
        asked = growing.withColumn("target", target)
        if o.predicted_intensity:
            asked = asked.where(F.col("seed.intensity_max") * F.get("pattern", F.lit(k)) / F.get("pattern", F.lit(0)) >= F.col("seed_floor"))
        if surface is not None:
            asked = looked_up(asked.withColumns({"mz": F.col("target"), "rt": F.col("seed.rt")}), surface)
            asked = asked.withColumn("target", F.col("target") * (1 + F.coalesce("centre", F.lit(0.0)) * 1e-6)).drop("mz", "rt", "centre", "spread")
        asked = asked.withColumns({
            "tolerance": F.col("seed.mz") * F.col("seed_ppm") * 1e-6, "ref_start": F.col("last.scan_start"), "ref_end": F.col("last.scan_end"),
            "ref_im": F.col("last.im"), "ref_intensity": F.col("last.intensity_max"), "taken": F.transform("members", lambda m: m.hill_id),
        })
        found = neighbours(asked, hills, o.ppm, 1, o.min_step_ratio, o.im_tolerance, o.im_relative)
        anchor = "seed" if o.seed_cosine else "last"
        cosine = lambda c: elution_cosine(F.col(f"{c}.profile"), F.col("hill.profile"), F.col(f"{c}.scan_start"), F.col("hill.scan_start"), o.min_overlap)
        found = found.withColumn("cosine", cosine(anchor)).withColumn("to_seed", F.col("cosine") if o.seed_cosine else cosine("seed"))
        # The greatest cosine, then the greatest m/z.
        keys = [*KEYS, F.col("seed.hill_id").alias("seed_id"), "charge"]
        held = ["seed", "seed_ppm", "last", "members", "hill", "cosine", "to_seed", *([] if k == 1 and not o.predicted_intensity else ["pattern"]), *(["seed_floor"] if o.predicted_intensity else [])]
        best = found.groupBy(*keys).agg(F.max_by(F.struct(*held), F.struct("cosine", "hill.mz", "hill.hill_id")).alias("b")).select(*KEYS, "charge", "b.*")
        step = best.where(F.col("cosine") >= o.min_cosine)
        if k == 1 and not o.predicted_intensity:  # a seed's pattern goes with its chain from here on
            step = with_patterns(step.withColumn("mass", neutral_mass(F.col("seed.mz"), F.col("charge"))), "mass").drop("mass")
        step = step.withColumn("wanted", F.log2(F.greatest(F.lit(1e-12), F.get("pattern", F.lit(k))) / F.greatest(F.lit(1e-12), F.get("pattern", F.lit(k - 1)))))
        step = step.where(F.abs(F.log2(F.col("hill.intensity_max") / F.col("last.intensity_max")) - F.col("wanted")) <= o.max_log2_ratio)
        hill = {c: F.col(f"hill.{c}") for c in columns}
        growing = cut_lineage(step.select(*KEYS, "seed", "seed_ppm", "charge", "pattern", *(["seed_floor"] if o.predicted_intensity else []), F.col("hill").alias("last"), F.concat("members", F.array(member(hill, F.col("to_seed")))).alias("members")))
        grown = growing if grown is None else grown.unionByName(growing)
        if growing.isEmpty():
            break
    longest = grown.groupBy(*KEYS, F.col("seed.hill_id").alias("seed"), "charge", F.col("seed.mz").alias("seed_mz")).agg(F.max_by("members", F.size("members")).alias("members"))
    return longest


def with_evidence(chains: DataFrame, o: Chains = Chains()) -> DataFrame:
    """``chains`` with ``scores``: the log evidence of each prefix of two members or more, over the best sulfur template.

    A member adds the log ratio of its intensity step's density around the
    template to that around noise, and that of its cosine's.
    """
    rows = with_patterns(chains.withColumn("mass", neutral_mass(F.col("seed_mz"), F.col("charge"))), "mass", list(o.sulfur_offsets))
    a, s, n = o.cosine_shape, o.ratio_sigma, o.noise_sigma

    def adds(m, k, pattern):
        wanted = F.log2(F.get(pattern, k)) - F.log2(F.get(pattern, F.lit(0)))
        off = F.log2(m.intensity) - F.log2(F.get("members", F.lit(0)).intensity) - wanted
        value = math.log(n / s) - 0.5 * off * off * (s**-2 - n**-2) + math.log(a) + (a - 1) * F.log(F.least(F.lit(1.0), m.cosine))
        return F.when((F.coalesce(F.get(pattern, k), F.lit(0.0)) > 0) & (m.cosine > 0), value).otherwise(F.lit(float("-inf")))

    later = F.slice("members", 2, F.greatest(F.lit(1), F.size("members") - 1))
    sums = lambda t: F.aggregate(F.transform(later, lambda m, i: adds(m, i + 1, t.pattern)), F.array().cast("array<double>"), lambda held, x: F.concat(held, F.array(x + F.coalesce(F.get(held, F.size(held) - 1), F.lit(0.0)))))
    rows = rows.withColumn("by_template", F.transform("templates", sums))
    best = bound(F.col("by_template"), lambda b: F.transform(F.sequence(F.lit(0), F.size("members") - 2), lambda k: F.array_max(F.transform(b, lambda x: F.get(x, k)))))
    return rows.withColumn("scores", best).drop("mass", "pattern", "templates", "by_template")


def gated(chains: DataFrame, hills: DataFrame, o: Chains = Chains()) -> DataFrame:
    """``chains`` (of ``with_evidence``) whose prefixes below ``min_isotope_score`` cannot be claimed; a lesser prefix that passes still can.

    A prefix's score is the affinity of its isotopes at the apex of its summed
    profile with the best of its sulfur templates.
    """
    if o.min_isotope_score <= 0:
        return chains
    ends = F.explode(F.sequence(F.lit(2), F.size("members"))).alias("length")
    each = chains.select(*KEYS, "seed", "charge", "members", ends)
    each = each.select(*KEYS, F.struct("seed", "length").alias("seed"), "charge", F.slice("members", 1, F.col("length")).alias("members"))
    found = with_patterns(features(each, hills, o.min_overlap), "mass", list(o.sulfur_offsets))
    score = best_affinity(F.col("observed"), F.col("templates")).score
    good = found.where(score >= o.min_isotope_score).groupBy(*KEYS, "seed.seed", "charge").agg(F.collect_set("seed.length").alias("good"))  # a chain's lengths
    on = [F.col(f"c.{x}").eqNullSafe(F.col(f"g.{x}")) for x in (*KEYS, "seed", "charge")]
    rows = chains.alias("c").join(good.alias("g"), on, "left").select("c.*", F.coalesce("g.good", F.array().cast("array<int>")).alias("good"))
    return rows.withColumn("scores", F.transform("scores", lambda x, i: F.when(F.array_contains("good", i + 2), x).otherwise(F.lit(float("-inf"))))).drop("good")


def _best_prefix(members, scores):
    """(evidence, end): the best finite prefix among ``members``, the shortest of equal ones."""
    ends = F.transform(F.slice(scores, 1, F.greatest(F.lit(1), F.size(members) - 1)), lambda x, i: F.struct(x.alias("evidence"), (i + 2).alias("length")))
    return F.aggregate(ends, F.struct(F.lit(float("-inf")).alias("evidence"), F.lit(0).alias("length")), lambda best, x: F.when(x.evidence > best.evidence, x).otherwise(best))


def resolved(chains: DataFrame) -> DataFrame:
    """run, channel, seed, charge, evidence, members: the chains that stand when every hill is used once.

    The greatest evidence goes first, then the lower seed, then the lower
    charge.  In each round the chains that come before all that share a hill
    with them stand; the others keep what is free from their start on, with its
    own best prefix.
    """
    def ready(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("best", _best_prefix(F.col("members"), F.col("scores"))).where(F.col("best.length") >= 2)
        return rows.select(*KEYS, "seed", "charge", "seed_mz", F.col("best.evidence").alias("evidence"), F.slice("members", 1, F.col("best.length")).alias("members"), "scores")

    rows = cut_lineage(ready(chains).withColumn("rank", F.struct(-F.col("evidence"), F.col("seed_mz"), "seed", "charge")))
    accepted = None
    while True:
        each = rows.select(*KEYS, "seed", "charge", "rank", F.explode("members.hill_id").alias("hill_id"))
        first = each.groupBy(*KEYS, "hill_id").agg(F.min("rank").alias("first"))
        on = [F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*KEYS, "hill_id")]
        wins = each.alias("e").join(first.alias("f"), on).groupBy("e.run", "e.channel", "e.seed", "e.charge").agg(F.every(F.col("e.rank") == F.col("f.first")).alias("wins"))
        on = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (*KEYS, "seed", "charge")]
        rows = cut_lineage(rows.alias("r").join(wins.alias("w"), on).select("r.*", "w.wins"))
        won = rows.where("wins").drop("wins", "rank", "scores")
        accepted = won if accepted is None else accepted.unionByName(won)
        left = rows.where("not wins").drop("wins", "rank")
        if left.isEmpty():
            return accepted
        used = won.select(*KEYS, F.explode("members.hill_id").alias("hill_id"))
        each = left.select(*KEYS, "seed", "charge", F.posexplode("members.hill_id").alias("at", "hill_id"))
        on = [F.col(f"e.{c}").eqNullSafe(F.col(f"u.{c}")) for c in (*KEYS, "hill_id")]
        blocked = each.alias("e").join(used.alias("u"), on).groupBy("e.run", "e.channel", "e.seed", "e.charge").agg(F.min("e.at").alias("free"))
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*KEYS, "seed", "charge")]
        left = left.alias("l").join(blocked.alias("b"), on, "left").select("l.*", F.coalesce("b.free", F.size("l.members")).alias("free")).where("free >= 2")
        left = ready(left.withColumn("members", F.slice("members", 1, F.col("free"))))
        rows = cut_lineage(left.withColumn("rank", F.struct(-F.col("evidence"), F.col("seed_mz"), "seed", "charge")))


def features(chains: DataFrame, hills: DataFrame, min_overlap: int = 3) -> DataFrame:
    """run, channel, seed, charge, mz, mass, hill_ids, n_isotopes, cosine_score, ppm_error (means over adjacent hills), rt_apex,
    rt_start, rt_end, im, scan_start, profile (summed), apex_scan, intensity_sum, intensity_apex, observed (isotopes at the apex)."""
    each = chains.select(*KEYS, "seed", "charge", F.explode("members.hill_id").alias("hill_id"))
    names = ["hill_id", "mz", "rt", "rt_start", "rt_end", "im", "scan_start", "scan_end", "intensity_sum", "intensity_max", "profile"]
    on = [F.col(f"c.{x}").eqNullSafe(F.col(f"h.{x}")) for x in (*KEYS, "hill_id")]
    joined = each.alias("c").join(hills.alias("h"), on).select(*[f"c.{x}" for x in (*KEYS, "seed", "charge")], F.struct(*[F.col(f"h.{x}") for x in ["mz", *[n for n in names if n != "mz"]]]).alias("hill"))
    rows = joined.groupBy(*KEYS, "seed", "charge").agg(F.sort_array(F.collect_list("hill")).alias("hills"))  # a chain has a few hills
    pairs = F.transform(F.sequence(F.lit(0), F.size("hills") - 2), lambda i: F.struct(F.get("hills", i).alias("a"), F.get("hills", i + 1).alias("b")))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    step = NEUTRON / F.col("charge")
    cosines = F.transform(pairs, lambda p: elution_cosine(p.a.profile, p.b.profile, p.a.scan_start, p.b.scan_start, min_overlap))
    errors = F.transform(pairs, lambda p: (p.b.mz - (p.a.mz + step)) / (p.a.mz + step) * 1e6)
    low, high = F.array_min(F.transform("hills", lambda h: h.scan_start)), F.array_max(F.transform("hills", lambda h: h.scan_end))
    at = lambda h, scan: F.coalesce(F.get(h.profile, scan - h.scan_start), F.lit(0.0))
    rows = rows.withColumns({"cosine_score": mean(cosines), "ppm_error": mean(errors), "scan_start": low, "scan_end": high})
    rows = rows.withColumn("profile", F.transform(F.sequence("scan_start", "scan_end"), lambda scan: F.aggregate("hills", F.lit(0.0), lambda s, h: s + F.when(scan >= h.scan_start, at(h, scan)).otherwise(0.0))))
    last = F.size("profile") - F.array_position(F.reverse("profile"), F.array_max("profile")).cast("int")
    rows = rows.withColumn("apex_scan", F.col("scan_start") + last)
    tallest = F.aggregate("hills", F.get("hills", F.lit(0)), lambda b, h: F.when(h.intensity_max >= b.intensity_max, h).otherwise(b))
    rows = rows.withColumn("top", tallest)
    mz = F.get("hills", F.lit(0)).mz
    return rows.select(
        *KEYS, "seed", "charge", mz.alias("mz"), neutral_mass(mz, F.col("charge")).alias("mass"), F.transform("hills", lambda h: h.hill_id).alias("hill_ids"), F.size("hills").alias("n_isotopes"),
        "cosine_score", "ppm_error", F.col("top.rt").alias("rt_apex"), F.array_min(F.transform("hills", lambda h: h.rt_start)).alias("rt_start"), F.array_max(F.transform("hills", lambda h: h.rt_end)).alias("rt_end"),
        F.col("top.im").alias("im"), "scan_start", "profile", "apex_scan", F.aggregate("hills", F.lit(0.0), lambda s, h: s + h.intensity_sum).alias("intensity_sum"), F.array_max("profile").alias("intensity_apex"),
        F.transform("hills", lambda h: F.when(F.col("apex_scan") >= h.scan_start, at(h, F.col("apex_scan"))).otherwise(0.0)).alias("observed"),
    )


def spacing_residuals(found: DataFrame, hills: DataFrame, most_ppm: float = 40.0) -> DataFrame:
    """run, mz, rt, residual (ppm) of each pair of adjacent hills of a feature, against a neutron's step."""
    each = found.select(*KEYS, "seed", "charge", F.explode("hill_ids").alias("hill_id"))
    on = [F.col(f"c.{x}").eqNullSafe(F.col(f"h.{x}")) for x in (*KEYS, "hill_id")]
    rows = each.alias("c").join(hills.select(*KEYS, "hill_id", "mz", "rt").alias("h"), on).select(*[f"c.{x}" for x in (*KEYS, "seed", "charge")], "h.mz", "h.rt")
    before = F.lag("mz").over(Window.partitionBy(*KEYS, "seed", "charge").orderBy("mz"))
    step = NEUTRON / F.col("charge")
    rows = rows.withColumn("gap", F.col("mz") - before).where(F.abs(F.col("gap") - step) <= 0.5 * step)
    return rows.select(*KEYS, "mz", "rt", ((F.col("gap") - step) / F.col("mz") * 1e6).alias("residual")).where(F.abs("residual") <= most_ppm)


def unit(*names: str):
    """A number for a run's channel, which may be null."""
    return F.xxhash64(*(names or KEYS)).alias("unit")


def recalibration(residuals: DataFrame, least: int = 50) -> DataFrame:
    """The surface of each run's channel from its ``spacing_residuals``, by ``unit``; none where there are fewer than ``least``."""
    return recalibration_surface(residuals.select(unit(), "mz", "rt", "residual"), least=least, keys=("unit",))


def looked_up(rows: DataFrame, surface: DataFrame, mz_bins: int = 20, rt_bins: int = 8) -> DataFrame:
    """``rows`` (mz, rt) with centre and spread of a ``recalibration_surface``: of the cell, else the column, else the whole.

    Places beyond the surface take its edge bins.  A surface with ``unit`` is
    that of each run's channel; where a channel has none, both are null.  The
    surface is broadcast: ``mz_bins * (rt_bins + 1) + 1`` rows at most a channel.
    """
    value = F.struct("centre", "spread")
    made = [F.map_from_entries(F.collect_list(F.struct((F.col("mz_bin") * 1000 + F.col("rt_bin")).alias("k"), value.alias("v")))).alias("cells"), *[F.max(c).alias(c) for c in ("mz_low", "mz_high", "rt_low", "rt_high")]]
    if "unit" in surface.columns:
        near = rows.withColumn("unit", unit()).join(F.broadcast(surface.groupBy("unit").agg(*made)), "unit", "left")
    else:
        near = rows.join(F.broadcast(surface.agg(*made)))
    near = near.withColumns({"__m": surface_bin("mz", mz_bins) * 1000, "__r": surface_bin("rt", rt_bins)})
    got = F.coalesce(*[F.try_element_at("cells", k) for k in (F.col("__m") + F.col("__r"), F.col("__m") - 1, F.lit(-1001))])
    return near.withColumn("__got", got).select(*rows.columns, F.col("__got.centre").alias("centre"), F.col("__got.spread").alias("spread"))
