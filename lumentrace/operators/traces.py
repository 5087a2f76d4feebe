"""Traces: peaks of a channel in consecutive scans, and what is measured on them.

A trace ends when more than ``max_gap`` scans in a row lack a peak, and counts
if it has ``min_scans`` peaks.  Peaks are shuffled by channel once; measures
work on a trace's profile array, with 0 in the scans that lack a peak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.functions.binding import bound

MAX_GAP, MIN_SCANS = 1, 3


def members(peaks: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """``peaks`` with ``trace``, the number of the trace in its channel."""
    peaks = peaks.repartition("channel")  # all windows and groups below go by channel first
    by_scan = Window.partitionBy("channel").orderBy("scan")
    opens = F.coalesce(F.col("scan") - F.lag("scan").over(by_scan) > max_gap + 1, F.lit(True)).cast("int")
    return peaks.withColumn("opens", opens).withColumn("trace", F.sum("opens").over(by_scan.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("opens")


def traces(peaks: DataFrame, max_gap: int = MAX_GAP, min_scans: int = MIN_SCANS) -> DataFrame:
    """Extent, coverage, intensity and apex (the last greatest peak) of each trace."""
    found = members(peaks, max_gap).groupBy("channel", "trace").agg(
        F.min("scan").alias("scan_start"),
        F.max("scan").alias("scan_end"),
        F.count("*").alias("n_scans"),
        F.sum("intensity").alias("intensity_sum"),
        F.max("intensity").alias("intensity_max"),
        F.max(F.struct("intensity", "scan")).getField("scan").alias("scan_apex"),
    )
    return found.where(F.col("n_scans") >= min_scans).withColumn("skipped", F.col("scan_end") - F.col("scan_start") + 1 - F.col("n_scans"))


TRACES_SQL = f"""
opened as (select *, case when scan - lag(scan) over (partition by channel order by scan) <= {MAX_GAP + 1} then 0 else 1 end as opens from peaks),
members as (select channel, scan, intensity, mz_weighted, (sum(opens) over (partition by channel order by scan rows unbounded preceding))::int as trace from opened),
traces as (
  select channel, trace, min(scan) as scan_start, max(scan) as scan_end, count(*) as n_scans, sum(intensity)::bigint as intensity_sum,
    max(intensity) as intensity_max, arg_max(scan, (intensity, scan)) as scan_apex, max(scan) - min(scan) + 1 - count(*) as skipped
  from members group by channel, trace having count(*) >= {MIN_SCANS}
)"""


def moments(peaks: DataFrame) -> DataFrame:
    """Intensity-weighted mean, spread and Kish standard error of a trace's positions."""
    rows = members(peaks).withColumn("mz", F.col("mz_weighted") / F.col("intensity"))
    w, x = F.col("intensity").cast("double"), F.col("mz")
    sums = rows.groupBy("channel", "trace").agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx"))
    mean = F.col("swx") / F.col("sw")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("swxx") / F.col("sw") - mean * mean))
    effective = F.greatest(F.lit(1.0), F.col("sw") * F.col("sw") / F.col("sww"))
    error = F.when(F.col("n") < 2, 0.0).otherwise(spread / F.sqrt(effective))
    return sums.where(F.col("n") >= MIN_SCANS).select("channel", "trace", F.round(mean, 6).alias("mz"), F.round(spread, 4).alias("mz_std"), F.round(error, 4).alias("mz_se"))


def filled(peaks: DataFrame) -> DataFrame:
    """Every scan of every trace: gaps filled linearly, then a running box mean of half width 1."""
    rows = members(peaks)
    by_scan = Window.partitionBy("channel", "trace").orderBy("scan")
    nxt = F.lead(F.struct("scan", "intensity")).over(by_scan)
    steps = rows.withColumn("nxt", nxt).withColumn("step", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("nxt.scan") - F.col("scan") - 1, F.lit(0)))))
    value = F.col("intensity") + F.when(F.col("step") > 0, (F.col("nxt.intensity") - F.col("intensity")) * F.col("step") / (F.col("nxt.scan") - F.col("scan"))).otherwise(0.0)
    whole = steps.select("channel", "trace", (F.col("scan") + F.col("step")).alias("scan"), value.alias("value"), (F.col("step") > 0).alias("gap"))
    near = Window.partitionBy("channel", "trace").orderBy("scan").rowsBetween(-1, 1)
    return whole.withColumn("smooth", F.round(F.avg("value").over(near), 4)).withColumn("value", F.round("value", 4))


def profiles(peaks: DataFrame, max_gap: int = MAX_GAP, min_scans: int = MIN_SCANS) -> DataFrame:
    """channel, trace, scan_start, scan_end, profile (intensities from the first scan to the last, 0 in gaps)."""
    by_scan = Window.partitionBy("channel", "trace").orderBy("scan")
    rows = members(peaks, max_gap).withColumn("gap", F.coalesce(F.col("scan") - F.lag("scan").over(by_scan) - 1, F.lit(0)))
    found = rows.groupBy("channel", "trace").agg(F.min("scan").alias("scan_start"), F.max("scan").alias("scan_end"), F.sort_array(F.collect_list(F.struct("scan", "gap", F.col("intensity").cast("double").alias("v")))).alias("points"))
    whole = F.flatten(F.transform("points", lambda p: F.concat(F.array_repeat(F.lit(0.0), p.gap), F.array(p.v))))
    return found.where(F.size("points") >= min_scans).select("channel", "trace", "scan_start", "scan_end", whole.alias("profile"))


def last_peak(profile) -> F.Column:
    """Index of the last greatest value."""
    return F.size(profile) - F.array_position(F.reverse(profile), F.array_max(profile)).cast("int")


def shape_score(profile) -> F.Column:
    """Share of steps that rise to the (last) apex or fall from it; ties count, and 1 where there are no steps."""
    good = lambda i, apex: F.when(i < apex, F.get(profile, i) <= F.get(profile, i + 1)).otherwise(F.get(profile, i) >= F.get(profile, i + 1))
    right = bound(last_peak(profile), lambda apex: F.size(F.filter(F.sequence(F.lit(0), F.size(profile) - 2), lambda i: good(i, apex))))
    return F.when(F.size(profile) < 2, 1.0).otherwise(right / (F.size(profile) - 1))


def shape(peaks: DataFrame) -> DataFrame:
    return profiles(peaks).select("channel", "trace", F.round(shape_score(F.col("profile")), 6).alias("shape"))


def parabolic_apex(profile) -> F.Column:
    """Height of the parabola through the first greatest value and its neighbours, where it bends down."""
    at = F.array_position(profile, F.array_max(profile)).cast("int") - 1
    a, b, c = (F.get(profile, at + i) for i in (-1, 0, 1))
    bend = a - 2 * b + c
    inside = (at > 0) & (at + 1 < F.size(profile)) & (bend < 0)
    return F.when(inside, b - (c - a) * (c - a) / (8 * bend)).otherwise(b)


def _sum(values):
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def estimators(peaks: DataFrame) -> DataFrame:
    """Sum of the five greatest scans, best sum of five scans in a row, and the parabolic apex height."""
    p, width = F.col("profile"), F.least(F.lit(5), F.size("profile"))
    rows = F.transform(F.sequence(F.lit(1), F.size(p) - width + 1), lambda i: _sum(F.slice(p, i, width)))
    scattered = _sum(F.slice(F.sort_array(p, False), 1, 5))
    return profiles(peaks).select("channel", "trace", F.round(scattered, 3).alias("scattered5"), F.round(F.array_max(rows), 3).alias("consecutive5"), F.round(parabolic_apex(p), 3).alias("parabolic"))


def overlapping(found: DataFrame, tolerance: float, min_overlap: int = 3, scans_a_slice: int = 64) -> DataFrame:
    """Pairs of traces whose apexes' intensities lie within a relative band and whose scans overlap.

    An equi-join on (bucket, slice): logarithmic buckets of the band's width, of
    which a trace meets its own and the next two, and slices of the scan axis,
    of which a trace is in all that it crosses; a pair counts in the first slice
    that both are in.
    """
    import math

    width = math.log1p(tolerance)
    bucket = F.floor(F.log("intensity_max") / width)
    slice_of = lambda c: F.floor(F.col(c) / scans_a_slice)
    slices = F.explode(F.sequence(slice_of("scan_start"), slice_of("scan_end"))).alias("slice")
    left = found.select(F.col("channel").alias("channel_a"), F.col("trace").alias("trace_a"), F.col("intensity_max").alias("x"), F.col("scan_start").alias("s"), F.col("scan_end").alias("e"), bucket.alias("b"), slices)
    left = left.withColumn("bucket", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).drop("b")
    right = found.select(F.col("channel").alias("channel_b"), F.col("trace").alias("trace_b"), F.col("intensity_max").alias("y"), F.col("scan_start").alias("s2"), F.col("scan_end").alias("e2"), bucket.alias("bucket"), slices)
    overlap = F.least("e", "e2") - F.greatest("s", "s2") + 1
    first = F.col("slice") == F.floor(F.greatest("s", "s2") / scans_a_slice)
    pairs = left.join(right, ["bucket", "slice"]).where(first & (F.col("y") >= F.col("x")) & (F.col("y") <= F.col("x") * (1 + tolerance)) & (overlap >= min_overlap) & (F.struct("channel_a", "trace_a") != F.struct("channel_b", "trace_b")))
    return pairs.select("channel_a", "trace_a", "channel_b", "trace_b", overlap.alias("overlap"))


def elution_cosine(p, q, p_start, q_start, min_overlap: int = 1) -> F.Column:
    """Dot product of two profiles over their shared scans by their whole norms; 0 below ``min_overlap`` shared scans."""
    start = F.greatest(p_start, q_start)
    shared = F.least(p_start + F.size(p), q_start + F.size(q)) - start
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    part = lambda a, a_start: F.slice(a, start - a_start + 1, F.greatest(shared, F.lit(1)))
    dot = _sum(F.zip_with(part(p, p_start), part(q, q_start), lambda x, y: x * y))
    whole = norm(p) * norm(q)
    return F.when((shared < min_overlap) | (whole <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / whole)))


def coelution(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of the profiles of paired traces; ``found`` as from ``profiles``, joined by id."""
    side = lambda i: found.select(F.col("channel").alias(f"channel_{i}"), F.col("trace").alias(f"trace_{i}"), F.col("scan_start").alias(f"start_{i}"), F.col("profile").alias(f"profile_{i}"))
    both = pairs.join(side("a"), ["channel_a", "trace_a"]).join(side("b"), ["channel_b", "trace_b"])
    cosine = elution_cosine(F.col("profile_a"), F.col("profile_b"), F.col("start_a"), F.col("start_b"))
    return both.select("channel_a", "trace_a", "channel_b", "trace_b", F.round(cosine, 6).alias("cosine"))


def median_of_three(peaks: DataFrame) -> DataFrame:
    """Running median of three over each trace's peaks; the ends keep their values."""
    rows = members(peaks)
    by_scan = Window.partitionBy("channel", "trace").orderBy("scan")
    a, b, c = F.lag("intensity").over(by_scan), F.col("intensity"), F.lead("intensity").over(by_scan)
    rows = rows.withColumns({"a": a, "c": c})
    middle = F.col("a") + b + F.col("c") - F.greatest("a", b, "c") - F.least("a", b, "c")
    return rows.select("channel", "trace", "scan", F.coalesce(middle, b).alias("value"))
