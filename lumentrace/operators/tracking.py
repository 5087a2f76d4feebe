"""Traces of peaks whose positions agree within a tolerance, from scan to scan.

``spectra`` rows are run, channel, scan, rt, mz, intensity, im (mobility; 0 or
null where there is none).  Scans of a channel are numbered densely.

A peak can only meet a trace whose mean position is within the tolerance, and a
mean lies among the positions that made it, so peaks on two sides of an empty
stretch as wide as the tolerance never meet.  ``islands`` cuts channels there,
and islands at scans without peaks that no trace bridges; each island is tracked
by itself, exactly as the whole channel would be.  The cuts come from the
occupied bins (a row for each bin, whatever the number of peaks), so no window
runs over a channel's peaks.  A task goes through its islands scan by scan and
holds only the traces that are open; where data are so dense that a channel has
no empty stretch, one task reads the channel.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.functions import profiles as kernels
from lumentrace.operators.statistics import rolling_scale

HILL = (
    "mz double, mz_std double, mz_se double, rt double, rt_start double, rt_end double, rt_width double, im double, im_std double, "
    "scan_start int, scan_apex int, scan_end int, n_scans int, skipped_scans int, intensity_sum double, intensity_max double, hill_score double, profile array<double>"
)


@dataclass(frozen=True)
class Tracking:
    ppm: float = 10.0
    max_gap: int = 1
    min_scans: int = 3
    #: Mobility tolerance, as a share of the trace's mean mobility or absolute; infinite where there is no mobility.
    im_tolerance: float = math.inf
    im_relative: bool = False
    #: Weight of the step in log2 intensity in a match's distance.
    step_weight: float = 0.0
    #: Share of a trace's intensity that it is cut down to, around its apex.
    coverage: float = 1.0
    fill: bool = False
    #: Half width of the running mean; 0 leaves profiles as they are.
    smooth: int = 0
    low: float = 0.0
    high: float = math.inf


def channel_key(voltage) -> F.Column:
    """A voltage as a channel: not a number and infinite are none, and minus zero is zero."""
    v = voltage.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v + F.lit(0.0))


def dense_scans(spectra: DataFrame) -> DataFrame:
    """``spectra`` with ``scan`` numbered from 0 by rt in each run and channel; scans without peaks have no rows."""
    each = spectra.select("run", "channel", "rt").distinct()
    nth = F.row_number().over(Window.partitionBy("run", "channel").orderBy("rt")) - 1  # a row for each scan
    each = each.withColumn("scan", nth)
    on = F.col("s.run").eqNullSafe(F.col("n.run")) & F.col("s.channel").eqNullSafe(F.col("n.channel")) & (F.col("s.rt") == F.col("n.rt"))
    return spectra.drop("scan").alias("s").join(each.alias("n"), on).select("s.*", "n.scan")


def islands(spectra: DataFrame, ppm: float, max_gap: int) -> DataFrame:
    """``spectra`` with ``island``: peaks of two islands of a channel can never be in one trace."""
    # A bin is as wide as the tolerance: an empty one between two bins keeps their peaks apart.
    rows = spectra.withColumn("bin", F.floor(F.log("mz") / -math.log1p(-ppm * 1e-6)))
    keys = ["run", "channel"]
    by_bin = Window.partitionBy(*keys).orderBy("bin")
    bins = rows.select(*keys, "bin").distinct()
    bins = bins.withColumn("opens", F.coalesce(F.col("bin") - F.lag("bin").over(by_bin) > 1, F.lit(True)).cast("int"))
    bins = bins.select(*keys, "bin", F.sum("opens").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)).alias("band"))
    null_safe = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    join = lambda left, right, names, add: left.alias("l").join(right.alias("r"), null_safe("l", "r", names)).select("l.*", f"r.{add}")
    rows = join(rows, bins, [*keys, "bin"], "band")
    by_scan = Window.partitionBy(*keys, "band").orderBy("scan")
    scans = rows.select(*keys, "band", "scan").distinct()
    scans = scans.withColumn("opens", F.coalesce(F.col("scan") - F.lag("scan").over(by_scan) > max_gap + 1, F.lit(True)).cast("int"))
    scans = scans.select(*keys, "band", "scan", F.sum("opens").over(by_scan.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    rows = join(rows, scans, [*keys, "band", "scan"], "stretch")
    return rows.withColumn("island", F.struct("band", "stretch")).drop("bin", "band", "stretch")


class _Trace:
    __slots__ = ("at", "im", "mz", "mz_mean", "im_mean", "n", "rt", "values", "number")

    def __init__(self, number: int):
        self.number, self.n, self.mz_mean, self.im_mean = number, 0, 0.0, 0.0
        self.at, self.mz, self.im, self.rt, self.values = [], [], [], [], []

    def add(self, scan: int, rt: float, mz: float, value: float, im: float) -> None:
        self.n += 1
        self.mz_mean += (mz - self.mz_mean) / self.n
        if im != 0:
            self.im_mean += (im - self.im_mean) / self.n
        for held, x in ((self.at, scan), (self.rt, rt), (self.mz, mz), (self.values, value), (self.im, im)):
            held.append(x)


def _weighted(x: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Weighted mean, spread and Kish standard error."""
    total = w.sum()
    if total <= 0:
        return 0.0, 0.0, 0.0
    mean = float((x * w).sum() / total)
    spread = float(np.sqrt(max(0.0, ((x - mean) ** 2 * w).sum() / total)))
    return mean, spread, 0.0 if len(x) < 2 else spread / math.sqrt(max(1.0, total**2 / (w**2).sum()))


def _finished(trace: _Trace, o: Tracking) -> dict | None:
    at = np.array(trace.at)
    p = np.zeros(at[-1] - at[0] + 1)
    p[at - at[0]] = trace.values
    first, last = kernels.covered(p, o.coverage)
    keep = (at - at[0] >= first) & (at - at[0] <= last)
    start, at, p = int(at[0]) + first, at[keep], p[first : last + 1]
    if (p > 0).sum() < o.min_scans:
        return None
    skipped = int((p == 0).sum())
    w, rt = np.array(trace.values)[keep], np.array(trace.rt)[keep]
    if o.fill:
        p = kernels.fill_gaps(p)
    if o.smooth:
        p = kernels.box_mean(p, o.smooth)
    apex = kernels.last_peak(p)
    here = np.flatnonzero(at == start + apex)
    apex_rt = float(rt[here[0]]) if len(here) else float(rt.min() + (rt.max() - rt.min()) * apex / max(1, len(p) - 1))
    mz, mz_std, mz_se = _weighted(np.array(trace.mz)[keep], w)
    ims = np.array(trace.im)[keep]
    im, im_std, _ = _weighted(ims[ims != 0], w[ims != 0]) if (ims != 0).any() else (0.0, 0.0, 0.0)
    return {
        "mz": mz, "mz_std": mz_std, "mz_se": mz_se, "rt": apex_rt, "rt_start": float(rt.min()), "rt_end": float(rt.max()), "rt_width": float(rt.max() - rt.min()), "im": im, "im_std": im_std,
        "scan_start": start, "scan_apex": start + apex, "scan_end": start + len(p) - 1, "n_scans": len(p), "skipped_scans": skipped,
        "intensity_sum": float(p.sum()), "intensity_max": float(p.max()), "hill_score": kernels.shape_score(p), "profile": p.tolist(),
    }


def step(active: list[_Trace], scan: int, peaks: list[tuple[float, float, float, float]], o: Tracking, next_number: int) -> tuple[list[_Trace], list[_Trace], int]:
    """One scan: (traces that go on, traces that ended before it, next number); ``peaks`` (mz, intensity, im, rt) by rising mz.

    Traces choose in the order of their last intensities, the greatest first;
    each takes the nearest peak in reach that none has taken, the lowest of
    equally near ones.  Peaks that none takes start traces.
    """
    ended = [t for t in active if t.at[-1] < scan - o.max_gap - 1]
    active = [t for t in active if t.at[-1] >= scan - o.max_gap - 1]
    positions = [p[0] for p in peaks]
    taken = [False] * len(peaks)
    for trace in sorted(active, key=lambda t: (-t.values[-1], t.number)):
        reach = trace.mz_mean * o.ppm * 1e-6
        im_reach = math.inf if trace.im_mean == 0 else trace.im_mean * o.im_tolerance if o.im_relative else o.im_tolerance
        best, least = None, math.inf
        for k in range(bisect_left(positions, trace.mz_mean - reach), len(peaks)):
            mz, value, im, _ = peaks[k]
            if mz > trace.mz_mean + reach:
                break
            if taken[k]:
                continue
            far = abs(mz - trace.mz_mean) / reach
            if math.isfinite(im_reach) and im != 0:
                if abs(im - trace.im_mean) > im_reach:
                    continue
                far += abs(im - trace.im_mean) / im_reach
            if o.step_weight > 0:
                far += o.step_weight * abs(math.log2(value / trace.values[-1]))
            if far < least:
                best, least = k, far
        if best is not None:
            taken[best] = True
            trace.add(scan, peaks[best][3], peaks[best][0], peaks[best][1], peaks[best][2])
    for k, (mz, value, im, rt) in enumerate(peaks):
        if not taken[k] and o.low <= mz <= o.high:
            trace = _Trace(next_number)
            trace.add(scan, rt, mz, value, im)
            active.append(trace)
            next_number += 1
    return active, ended, next_number


def tracked(rows, o: Tracking):
    """(key, measures) of the traces of ``rows``: (key, scan, rt, mz, intensity, im), sorted by key, scan and mz.

    Only the traces that are open at a scan are held.
    """
    active: list[_Trace] = []
    peaks: list[tuple[float, float, float, float]] = []
    key = scan = None
    number = 0

    def closed(traces):
        return [(key, h) for t in traces if (h := _finished(t, o)) is not None]

    for new_key, new_scan, rt, mz, value, im in rows:
        if peaks and (new_key != key or new_scan != scan):
            active, ended, number = step(active, scan, peaks, o, number)
            peaks = []
            yield from closed(ended)
        if new_key != key:
            yield from closed(active)
            active, number = [], 0
        key, scan = new_key, new_scan
        peaks.append((mz, value, im, rt))
    if peaks:
        active, ended, number = step(active, scan, peaks, o, number)
        yield from closed(ended + active)


def track(spectra: DataFrame, options: Tracking = Tracking()) -> DataFrame:
    """run, channel, HILL's columns: the traces of each run and channel."""
    kinds = ", ".join(f"{c} {spectra.schema[c].dataType.simpleString()}" for c in ("run", "channel"))
    rows = spectra.where((F.col("intensity") > 0) & (F.col("mz") > 0)).select("run", "channel", "scan", "rt", "mz", "intensity", F.coalesce("im", F.lit(0.0)).cast("double").alias("im"))
    names = [c.split()[0] for c in HILL.split(", ")]

    def solve(batches):
        def each():
            for part in batches:
                channels = [None if c is None or c != c else c for c in part["channel"].tolist()]  # pandas has null numbers as not a number
                keys = zip(part["run"], channels, part["band"], part["stretch"])
                yield from zip(keys, *(part[c].tolist() for c in ("scan", "rt", "mz", "intensity", "im")))

        held = []

        def frame():
            out = pd.DataFrame([h for _, h in held], columns=names)
            out.insert(0, "channel", [k[1] for k, _ in held])
            out.insert(0, "run", [k[0] for k, _ in held])
            return out

        for found in tracked(each(), options):
            held.append(found)
            if len(held) == 5000:
                yield frame()
                held = []
        if held:
            yield frame()

    cut = islands(rows, options.ppm, options.max_gap).select("run", "channel", F.col("island.band").alias("band"), F.col("island.stretch").alias("stretch"), "scan", "rt", "mz", "intensity", "im")
    cut = cut.repartition("run", "channel", "band", "stretch").sortWithinPartitions("run", "channel", "band", "stretch", "scan", "mz", "intensity")
    return cut.mapInPandas(solve, f"{kinds}, {HILL}")


def numbered(hills: DataFrame) -> DataFrame:
    """``hills`` with ``hill_id``, from 0 in each run: channels in order (none first), then start, position and extent."""
    order = [F.col("channel").asc_nulls_first(), "scan_start", "mz", "scan_end", F.col("intensity_sum")]
    return hills.withColumn("hill_id", (F.row_number().over(Window.partitionBy("run").orderBy(*order)) - 1).cast("long"))


def split(hills: DataFrame, **options) -> DataFrame:
    """Hills of several peaks cut into their parts; times and measures of a part come from its stretch of the profile.

    Times are interpolated on scans; position and mobility are the hill's.  Parts
    shorter than ``min_scans`` go; a hill whose parts all go stays whole.
    """
    least = options.get("min_scans", 3)

    def cut(batches):
        for rows in batches:
            out = []
            for h in rows.to_dict("records"):
                p = np.asarray(h["profile"], float)
                bounds = [0, *kernels.split_points(p, **options), len(p)]
                parts = [(a, b) for a, b in zip(bounds, bounds[1:]) if b - a >= least] if len(bounds) > 2 else []
                out += [_part(h, p, a, b) for a, b in parts] or [h]
            yield pd.DataFrame(out, columns=rows.columns)

    return hills.mapInPandas(cut, hills.schema)


def _part(h: dict, p: np.ndarray, a: int, b: int) -> dict:
    part = p[a:b]
    time = lambda i: h["rt_start"] + h["rt_width"] * i / max(1, len(p) - 1)
    apex = kernels.last_peak(part)
    return h | {
        "rt": time(a + apex), "rt_start": time(a), "rt_end": time(b - 1), "rt_width": time(b - 1) - time(a), "scan_start": h["scan_start"] + a, "scan_apex": h["scan_start"] + a + apex, "scan_end": h["scan_start"] + b - 1,
        "n_scans": b - a, "skipped_scans": int((part == 0).sum()), "intensity_sum": float(part.sum()), "intensity_max": float(part.max()), "hill_score": kernels.shape_score(part), "profile": part.tolist(),
    }


def without_baselines(hills: DataFrame, min_scans: int = 40, factor: float = 2.0) -> DataFrame:
    """``hills`` less the long ones that do not stand out above their ends."""

    @F.pandas_udf("boolean")
    def flat(p: pd.Series) -> pd.Series:
        return p.map(lambda x: kernels.is_baseline(np.asarray(x, float), min_scans, factor))

    return hills.where((F.size("profile") < min_scans) | ~flat("profile"))


def options_for(level: int, base: Tracking = Tracking(), **fragment) -> Tracking:
    """``base`` for the first level; for the second with the fields of ``fragment`` that are given."""
    return base if level == 1 else Tracking(**asdict(base) | {k: v for k, v in fragment.items() if v is not None})


def clip_noise(spectra: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Peaks above their scan's noise: median + sigma * 1.4826 * MAD of what stays below it, until nothing more leaves.

    ``spectra`` has scans of three peaks or more clipped; smaller ones pass.
    """
    keys = ["run", "channel", "scan"]
    scans = spectra.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("intensity").cast("double"))).alias("all"))

    def middle(a):
        n = F.size(a)
        return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2

    def threshold(a):
        centre = F.transform(F.array(a), middle)
        off = F.transform(centre, lambda m: middle(F.array_sort(F.transform(a, lambda x: F.abs(x - m)))))
        return F.get(centre, F.lit(0)) + sigma * 1.4826 * F.get(off, F.lit(0))

    def shrink(state, _):
        less = F.transform(F.array(threshold(state.left)), lambda t: F.filter(state.left, lambda x: x <= t))[0]
        now = F.transform(F.array(less), lambda a: F.struct(a.alias("left"), (F.size(a) == F.size(state.left)).alias("done")))[0]
        return F.when(state.done | (F.size(state.left) < 3), state).otherwise(now)

    # Each turn takes a peak at least or is the last, so there are no more turns than peaks.
    kept = F.aggregate(F.sequence(F.lit(1), F.size("all")), F.struct(F.col("all").alias("left"), F.lit(False).alias("done")), shrink).left
    scans = scans.withColumn("noise", F.when(F.size("all") >= 3, kept)).select(*keys, F.when(F.col("noise").isNotNull() & (F.size("noise") > 0), threshold(F.col("noise"))).alias("floor"))
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys]
    return spectra.alias("s").join(scans.alias("n"), on).where(F.col("n.floor").isNull() | (F.col("s.intensity") > F.col("n.floor"))).select("s.*")


def normalised_scans(spectra: DataFrame, window: int = 11, low: float = 0.5, high: float = 3.0, median: bool = False) -> DataFrame:
    """``spectra`` with intensities scaled scan by scan: a run's rolling median of its scans' sums over the scan's own, clamped.

    With ``median`` scans are compared by their median intensity.  Scans count in
    the order of the run, whatever their channels; a run of one scan stays.
    """
    value = F.median("intensity") if median else F.sum(F.col("intensity").cast("double"))
    scans = spectra.groupBy("run", "scan").agg(value.cast("double").alias("value"))
    scales = rolling_scale(scans.select(F.col("run").alias("channel"), F.col("scan").alias("seq"), "value"), window, low, high)
    scales = scales.select(F.col("channel").alias("run"), F.col("seq").alias("scan"), "scale")
    return spectra.join(scales, ["run", "scan"]).withColumn("intensity", F.col("intensity") * F.col("scale")).select(*spectra.columns)


def shuffled_scans(spectra: DataFrame, seed: int = 0) -> DataFrame:
    """Decoys: each channel's scans in the order of a hash, the same on every run."""
    scans = spectra.select("run", "channel", "scan").distinct()
    window = Window.partitionBy("run", "channel")  # a row for each scan
    scans = scans.withColumn("nth", F.row_number().over(window.orderBy("scan"))).withColumn("drawn", F.row_number().over(window.orderBy(F.md5(F.concat_ws(":", F.col("scan").cast("string"), F.lit(str(seed)))), "scan")))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("run", "channel")]
    moved = scans.alias("a").join(scans.alias("b"), [*on, F.col("a.nth") == F.col("b.drawn")]).select("a.run", "a.channel", F.col("a.scan").alias("scan"), F.col("b.scan").alias("new"))
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("run", "channel", "scan")]
    return spectra.alias("s").join(moved.alias("m"), on).select(*[F.col("m.new").alias("scan") if c == "scan" else F.col(f"s.{c}") for c in spectra.columns])
