"""Aligning runs to a reference: anchors, a consensus line, a monotone warp, drift.

``features`` rows are run, feature_id, mz, charge, rt, im (0 where unknown), score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.operators import statistics as st


@dataclass(frozen=True)
class Warping:
    anchor_ppm: float = 10.0
    rt_window: float = 0.1
    im_tolerance: float = 0.05
    min_score: float = 0.5
    min_anchors: int = 20
    bandwidth: float = 0.1
    threshold: float = 0.02
    draws: int = 4000
    passes: int = 4
    seed: int = 0


def rt_ranges(features: DataFrame, scan_times: DataFrame | None = None) -> DataFrame:
    """run, low, high: the extent of ``scan_times`` (run, rt) where there are any, else of the features' times, else 0 to 1."""
    extent = lambda df: df.where(~F.isnan("rt") & (F.abs("rt") < float("inf"))).groupBy("run").agg(F.min("rt").alias("a"), F.max("rt").alias("b"))
    out = features.select("run").distinct().join(extent(features).withColumnsRenamed({"a": "low", "b": "high"}), "run", "left")
    if scan_times is not None:
        out = out.join(extent(scan_times), "run", "left").select("run", F.coalesce("a", "low").alias("low"), F.coalesce("b", "high").alias("high"))
    return out.select("run", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"))


def normalise(rt, low, high) -> Column:
    """Position in an extent from 0 to 1, clamped; 0.5 where there is none."""
    return F.when(high <= low, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rt - low) / (high - low))))


def denormalise(x, low, high) -> Column:
    return low + x * (high - low)


def mobility_scale(features: DataFrame, most: float = 10.0) -> DataFrame:
    """``features``; an error where some runs have mobilities above ``most`` (indices) and others below (physical units)."""
    scales = features.where("im > 0").groupBy("run").agg((F.max("im") > most).alias("index")).agg(F.count_distinct("index").alias("n"))
    checked = scales.select(F.when(F.col("n") > 1, F.raise_error(F.lit("runs differ in the scale of mobility"))).otherwise(F.lit(True)).alias("ok"))
    return features.join(F.broadcast(checked), F.coalesce("ok", F.lit(True)))


def anchor_candidates(features: DataFrame, reference: str, o: Warping = Warping()) -> DataFrame:
    """run, charge, ref_id, run_id, ref_mz, run_mz, ref_rt, run_rt (0 to 1), ref_im, run_im, ppm: pairs within all tolerances."""
    ranges = rt_ranges(features)
    rows = features.where((F.col("charge") > 0) & (F.col("score") >= o.min_score)).join(F.broadcast(ranges), "run")  # a row for each run
    rows = rows.select("run", "feature_id", "charge", "mz", normalise(F.col("rt"), F.col("low"), F.col("high")).alias("x"), "im", F.floor(F.log("mz") / math.log1p(o.anchor_ppm * 1e-6)).alias("bin"))
    side = lambda df, s: df.select("charge", F.col("bin").alias(f"{s}_bin"), *[F.col(a).alias(f"{s}_{b}") for a, b in (("feature_id", "id"), ("mz", "mz"), ("x", "rt"), ("im", "im"))])
    ref = side(rows.where(F.col("run") == reference), "ref").withColumn("bin", F.explode(F.array(F.col("ref_bin") - 1, F.col("ref_bin"), F.col("ref_bin") + 1)))
    run = rows.where(F.col("run") != reference)
    run = run.select("run", "charge", F.col("bin"), *[F.col(a).alias(f"run_{b}") for a, b in (("feature_id", "id"), ("mz", "mz"), ("x", "rt"), ("im", "im"))])
    pairs = ref.join(run, ["charge", "bin"])
    near = (F.abs(F.col("run_mz") - F.col("ref_mz")) <= F.col("ref_mz") * o.anchor_ppm * 1e-6) & (F.abs(F.col("run_rt") - F.col("ref_rt")) <= o.rt_window)
    near = near & ((F.col("ref_im") == 0) | (F.col("run_im") == 0) | (F.abs(F.col("run_im") - F.col("ref_im")) <= o.im_tolerance))
    return pairs.where(near).select("run", "charge", "ref_bin", "ref_id", "run_id", "ref_mz", "run_mz", "ref_rt", "run_rt", "ref_im", "run_im", (F.abs(F.col("run_mz") - F.col("ref_mz")) / F.col("ref_mz") * 1e6).alias("ppm"))


ANCHOR = "ref_mz double, run_mz double, ref_rt double, run_rt double, ref_im double, run_im double, ppm double"


def anchors(candidates: DataFrame) -> DataFrame:
    """One run feature for each reference feature, in the order of m/z: the nearest by ppm that none before took.

    Bins without candidates cut a run's charge into islands that share no
    feature; a task reads its islands in order and remembers one island's claims.
    """
    keys = ["run", "charge"]
    by_bin = Window.partitionBy(*keys).orderBy("ref_bin")  # a row for each occupied bin
    bins = candidates.select(*keys, "ref_bin").distinct()
    opens = F.coalesce(F.col("ref_bin") - F.lag("ref_bin").over(by_bin) > 3, F.lit(True)).cast("int")
    bins = bins.withColumn("opens", opens).select(*keys, "ref_bin", F.sum("opens").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    rows = candidates.join(bins, [*keys, "ref_bin"]).drop("ref_bin")
    rows = rows.repartition(*keys, "island").sortWithinPartitions(*keys, "island", "ref_mz", "ref_id", "ppm", "run_mz", "run_id")

    def choose(batches):
        island, done, used = None, None, set()
        for part in batches:
            keep = []
            for key, ref, run in zip(zip(part["run"], part["charge"], part["island"]), part["ref_id"], part["run_id"]):
                if key != island:
                    island, done, used = key, None, set()
                take = ref != done and run not in used
                if take:
                    done = ref
                    used.add(run)
                keep.append(take)
            yield part[keep].drop(columns="island")

    kinds = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in ("run", "charge", "ref_id", "run_id"))
    return rows.select("run", "charge", "ref_id", "run_id", *[c.split()[0] for c in ANCHOR.split(", ")], "island").mapInPandas(choose, f"{kinds}, {ANCHOR}")


def isotonic(y: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence (pools of adjacent violators)."""
    pools: list[list[float]] = []
    for v in y:
        pools.append([float(v), 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, n2 = pools.pop()
            v1, n1 = pools.pop()
            pools.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.repeat([v for v, _ in pools], [int(n) for _, n in pools])


def knots(x: np.ndarray, y: np.ndarray, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, shifts) of a monotone map x -> x + shift: medians around centres half a bandwidth apart, of three pairs or more."""
    if not len(x):
        return np.array([0.0, 1.0]), np.zeros(2)
    half = bandwidth / 2
    centres = np.minimum(1.0, np.arange(0, 1 + half * 0.5 + 1e-12, half))
    found = [(c, float(np.median((y - x)[near]))) for c in centres if (near := np.abs(x - c) <= half).sum() >= 3]
    if not found:
        return np.array([0.0, 1.0]), np.full(2, float(np.median(y - x)))
    kx, ky = map(np.array, zip(*found))
    if kx[0] > 1e-6:
        kx, ky = np.r_[0.0, kx], np.r_[ky[0], ky]
    if kx[-1] < 1 - 1e-6:
        kx, ky = np.r_[kx, 1.0], np.r_[ky, ky[-1]]
    return kx, isotonic(kx + ky) - kx


def fit_warp(x: np.ndarray, y: np.ndarray, o: Warping) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(knot positions, shifts, which pairs count): the best line through two drawn pairs, then refits around the knots."""
    n = len(x)
    if n < o.min_anchors:
        return np.array([0.0, 1.0]), np.zeros(2), np.zeros(n, bool)
    rng = np.random.default_rng(o.seed)
    active, most = np.ones(n, bool), 0
    for i, j in rng.integers(0, n, (o.draws, 2)):
        if abs(x[i] - x[j]) < 1e-9:
            continue
        slope = (y[j] - y[i]) / (x[j] - x[i])
        near = np.abs(y - y[i] - slope * (x - x[i])) < o.threshold
        if (count := int(near.sum())) > most:
            active, most = near, count
    for _ in range(o.passes):
        before = int(active.sum())
        kx, ky = knots(x[active], y[active], o.bandwidth)
        active = np.abs(y - x - np.interp(x, kx, ky)) < o.threshold
        if active.sum() <= before:
            break
    if active.sum() < o.min_anchors:
        active = np.ones(n, bool)
    return *knots(x[active], y[active], o.bandwidth), active


def warps(pairs: DataFrame, o: Warping = Warping()) -> tuple[DataFrame, DataFrame]:
    """(run, knot_x, knot_y, n_inliers of each run; ``pairs`` with ``active``); a run's anchors, one for each reference feature at most, are one group."""
    kind = pairs.schema["run"].dataType.simpleString()

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ref_mz", "run_mz", "run_rt", "ref_rt"], kind="stable")  # draws do not depend on the rows' order
        kx, ky, active = fit_warp(part["run_rt"].to_numpy(), part["ref_rt"].to_numpy(), o)
        return pd.DataFrame({"run": [part["run"].iloc[0]], "knot_x": [kx.tolist()], "knot_y": [ky.tolist()], "n_inliers": [int(active.sum())], "all": [bool(active.sum() == len(active))], "none": [not active.any()]})

    lines = pairs.groupBy("run").applyInPandas(fit, f"run {kind}, knot_x array<double>, knot_y array<double>, n_inliers long, all boolean, none boolean")
    off = F.abs(F.col("ref_rt") - F.col("run_rt") - shift_at(F.col("run_rt"), F.col("knot_x"), F.col("knot_y")))
    marked = pairs.join(F.broadcast(lines), "run").withColumn("active", F.when(F.col("none"), False).otherwise(F.col("all") | (off < o.threshold)))
    return lines.select("run", "knot_x", "knot_y", "n_inliers"), marked.select(*pairs.columns, "active")


def shift_at(x, knot_x, knot_y) -> Column:
    """The warp's shift at a position: linear between knots, constant beyond the ends."""
    last = F.size(knot_x) - 1
    at = F.greatest(F.lit(0), F.least(last - 1, F.size(F.filter(knot_x, lambda k: k <= x)) - 1))
    a, b = F.get(knot_x, at), F.get(knot_x, at + 1)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
    return F.when(last < 1, F.coalesce(F.get(knot_y, F.lit(0)), F.lit(0.0))).otherwise(F.get(knot_y, at) + share * (F.get(knot_y, at + 1) - F.get(knot_y, at)))


def residuals(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Of the pairs that count: run, x, rt residual after the warp, m/z residual (ppm) and mobility difference, for spreads and drift lines."""
    rows = pairs.where("active").join(F.broadcast(lines), "run")
    off = F.col("ref_rt") - F.col("run_rt") - shift_at(F.col("run_rt"), F.col("knot_x"), F.col("knot_y"))
    im = F.when((F.col("ref_im") != 0) & (F.col("run_im") != 0), F.col("ref_im") - F.col("run_im"))
    return rows.select("run", F.col("run_rt").alias("x"), off.alias("residual"), ((F.col("ref_mz") - F.col("run_mz")) / F.col("run_mz") * 1e6).alias("ppm"), im.alias("im"))


def aligned(features: DataFrame, reference: str, lines: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """``features`` with ref_rt and ref_mz, their places in the reference's time and m/z; the reference's own stay.

    ``drift`` (run, slope, intercept) gives the ppm to add at a position.
    """
    ranges = rt_ranges(features)
    ref = ranges.where(F.col("run") == reference).select(F.col("low").alias("__ref_low"), F.col("high").alias("__ref_high"))
    rows = features.join(F.broadcast(ranges), "run").join(F.broadcast(ref)).join(F.broadcast(lines.select("run", "knot_x", "knot_y")), "run", "left")
    x = normalise(F.col("rt"), F.col("low"), F.col("high"))
    moved = denormalise(x + F.coalesce(shift_at(x, F.col("knot_x"), F.col("knot_y")), F.lit(0.0)), F.col("__ref_low"), F.col("__ref_high"))
    rows = rows.withColumn("ref_rt", F.when(F.col("run") == reference, F.col("rt")).otherwise(moved))
    ppm = F.lit(0.0)
    if drift is not None:
        rows = rows.join(F.broadcast(drift.select("run", "slope", "intercept")), "run", "left")
        ppm = F.coalesce(F.col("slope") * x + F.col("intercept"), F.lit(0.0))
    rows = rows.withColumn("ref_mz", F.when(F.col("run") == reference, F.col("mz")).otherwise(F.col("mz") * (1 + ppm * 1e-6)))
    return rows.select(*features.columns, "ref_rt", "ref_mz")


def expected_rt(ref_rt, ref_low, ref_high, low, high, knot_x, knot_y) -> Column:
    """Where a reference time lies in a run: the warp's shift at the reference position, taken back."""
    x = normalise(ref_rt, ref_low, ref_high)
    return denormalise(x - F.coalesce(shift_at(x, knot_x, knot_y), F.lit(0.0)), low, high)


def drift_lines(pairs: DataFrame, least_im: int = 4) -> DataFrame:
    """run, mz_slope, mz_intercept (ppm that a run measures too high), im_slope, im_intercept, on the reference's position.

    Lines with clip over all anchors; zero where there are fewer than two, for
    mobility fewer than ``least_im`` of known mobility on both sides.
    """
    mass = pairs.select("run", F.col("ref_rt").alias("x"), ((F.col("run_mz") - F.col("ref_mz")) / F.col("ref_mz") * 1e6).alias("value"))
    mobility = pairs.where("ref_im <> 0 and run_im <> 0").select("run", F.col("ref_rt").alias("x"), (F.col("run_im") - F.col("ref_im")).alias("value"))
    enough = mobility.groupBy("run").count().where(F.col("count") >= least_im).select("run")
    line = lambda rows, s: st.clipped_line(rows).select("run", F.col("slope").alias(f"{s}_slope"), F.col("intercept").alias(f"{s}_intercept"))
    out = pairs.select("run").distinct().join(line(mass, "mz"), "run", "left").join(line(mobility.join(F.broadcast(enough), "run"), "im"), "run", "left")  # a row for each run
    return out.na.fill(0.0)


def run_places(features: DataFrame, reference: str, lines: DataFrame, drift: DataFrame) -> DataFrame:
    """A row for each run: its extent and the reference's (low, high, ref_low, ref_high), its warp and its drift; the reference's are zero."""
    ranges = rt_ranges(features)
    ref = ranges.where(F.col("run") == reference).select(F.col("low").alias("ref_low"), F.col("high").alias("ref_high"))
    out = ranges.join(F.broadcast(ref)).join(lines.select("run", "knot_x", "knot_y"), "run", "left").join(drift, "run", "left")
    return out.withColumn("is_reference", F.col("run") == reference).na.fill(0.0, ["mz_slope", "mz_intercept", "im_slope", "im_intercept"])


def _shift(x) -> Column:
    return F.coalesce(shift_at(x, F.col("knot_x"), F.col("knot_y")), F.lit(0.0))


def to_reference(features: DataFrame, places: DataFrame, own_axis: bool = False) -> DataFrame:
    """``features`` with ref_rt, ref_mz, ref_im: their places in the reference.

    Drift is read at the position in the reference, which its lines are fitted
    on; with ``own_axis`` that of mobility is read at the run's own position.
    """
    names = [c for c in places.columns if c != "run"]
    rows = features.join(F.broadcast(places.select("run", F.struct(*names).alias("__p"))), "run").select("*", *[F.col(f"__p.{c}").alias(c) for c in names])  # a row for each run
    x = normalise(F.col("rt"), F.col("low"), F.col("high"))
    moved = denormalise(x + _shift(x), F.col("ref_low"), F.col("ref_high"))
    at = normalise(moved, F.col("ref_low"), F.col("ref_high"))
    ppm, off = F.col("mz_intercept") + F.col("mz_slope") * at, F.col("im_intercept") + F.col("im_slope") * (x if own_axis else at)
    own = lambda c, there: F.when(F.col("is_reference"), F.col(c)).otherwise(there).alias(f"ref_{c}")
    im = F.when(F.coalesce("im", F.lit(0.0)) == 0, F.col("im")).otherwise(F.col("im") - off)
    return rows.select(*features.columns, own("rt", moved), own("mz", F.col("mz") / (1 + ppm * 1e-6)), own("im", im))


def to_runs(groups: DataFrame, places: DataFrame) -> DataFrame:
    """``groups`` (ref_mz, ref_rt, ref_im) in each run: run, rt, mz, im where that run should have them, low and high."""
    each = groups.join(F.broadcast(places))  # a row for each group and run is the result
    x = normalise(F.col("ref_rt"), F.col("ref_low"), F.col("ref_high"))
    moved = denormalise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x - _shift(x))), F.col("low"), F.col("high"))
    ppm, off = F.col("mz_intercept") + F.col("mz_slope") * x, F.col("im_intercept") + F.col("im_slope") * x
    own = lambda c, there: F.when(F.col("is_reference"), F.col(f"ref_{c}")).otherwise(there).alias(c)
    im = F.when(F.col("ref_im") == 0, 0.0).otherwise(F.col("ref_im") + off)
    return each.select(*groups.columns, "run", own("rt", moved), own("mz", F.col("ref_mz") * (1 + ppm * 1e-6)), own("im", im), "low", "high")
