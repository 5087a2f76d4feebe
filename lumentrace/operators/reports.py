"""What an alignment and a quantification over runs came to, run by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.operators import alignment
from lumentrace.operators import statistics as st

#: Anchors of a run that a report shows; figures are those of all.
SHOWN = 500
SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def at_shares(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float] = SHARES) -> DataFrame:
    """keys, n, and by each share's name the value of the nearest rank, round(share * (n - 1)) from the least on."""
    each = rows.select(*keys, F.col(value).cast("double").alias("v"), F.lit(1).alias("c")).where("v is not null and not isnan(v)")
    ranked = st.cumulated(each, keys, [F.col("v")], ["c"])
    counts = each.groupBy(*keys).agg(F.count("*").alias("n"))
    near = ranked.join(F.broadcast(counts), keys)  # a row for each key
    place = lambda p: F.floor(p * (F.col("n") - 1) + 0.5) + 1
    return near.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("upto_c") == place(p), F.col("v"))).alias(name) for name, p in shares.items()])


def summaries(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median, mad (median distance from the median), std of finite values."""
    sound = rows.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('inf')")
    middle = st.medians(sound, keys, "v")
    off = sound.join(F.broadcast(middle.drop("n")), keys).select(*keys, F.abs(F.col("v") - F.col("median")).alias("off"))  # a row for each key
    spread = sound.groupBy(*keys).agg(F.stddev_samp("v").alias("std"))
    return middle.join(st.medians(off, keys, "off").select(*keys, F.col("median").alias("mad")), keys).join(spread, keys)


def anchor_residuals(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """``pairs`` (of ``warps``, with active) with ppm, im, rt before and after the run's models; mobility only where both sides have it."""
    rows = pairs.join(F.broadcast(places), "run")  # a row for each run
    both = (F.col("ref_im") != 0) & (F.col("run_im") != 0)
    before = {"ppm_before": (F.col("run_mz") - F.col("ref_mz")) / F.col("ref_mz") * 1e6, "im_before": F.when(both, F.col("run_im") - F.col("ref_im")), "rt_before": F.col("ref_rt") - F.col("run_rt")}
    rows = rows.withColumns(before)
    line = lambda s: F.col(f"{s}_intercept") + F.col(f"{s}_slope") * F.col("ref_rt")
    warp = F.coalesce(alignment.shift_at(F.col("run_rt"), F.col("knot_x"), F.col("knot_y")), F.lit(0.0))
    after = {"ppm_after": F.col("ppm_before") - line("mz"), "im_after": F.col("im_before") - line("im"), "rt_after": F.col("rt_before") - warp}
    absolute = {"run_time": alignment.denormalise(F.col("run_rt"), F.col("low"), F.col("high")), "ref_time": alignment.denormalise(F.col("ref_rt"), F.col("ref_low"), F.col("ref_high"))}
    return rows.withColumns(after | absolute).select(*pairs.columns, *before, *after, *absolute)


MEASURES = ["ppm_before", "ppm_after", "im_before", "im_after", "rt_before", "rt_after"]


def shown(residuals: DataFrame, most: int = SHOWN, seed: int = 0) -> DataFrame:
    """At most ``most`` anchors of each run, least hash first, the same on every run; the window keeps that many in each task before it shuffles."""
    drawn = F.xxhash64("ref_id", "run_id", F.lit(seed))
    nth = F.row_number().over(Window.partitionBy("run").orderBy(drawn, "ref_id", "run_id"))
    return residuals.withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__nth")


def alignment_report(pairs: DataFrame, places: DataFrame, most: int = SHOWN) -> DataFrame:
    """run, n_anchors, n_active, warp, drift, stats (figures of MEASURES over all anchors), anchors (some), as structs for JSON."""
    rows = anchor_residuals(pairs, places)
    each = rows.select("run", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x")).select("run", "x.*")
    figures = summaries(each, ["run", "measure"], "v")
    stats = figures.groupBy("run").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("measure", F.struct("n", "median", "mad", "std"))))).alias("stats"))  # a handful of measures
    counts = rows.groupBy("run").agg(F.count("*").alias("n_anchors"), F.count_if("active").alias("n_active"))
    names = [c for c in rows.columns if c != "run"]
    some = shown(rows, most).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("ref_rt", *[c for c in names if c != "ref_rt"]))).alias("anchors"))
    models = places.select("run", F.struct("knot_x", "knot_y").alias("warp"), F.struct("mz_slope", "mz_intercept", "im_slope", "im_intercept").alias("drift"))
    return counts.join(stats, "run").join(models, "run").join(some, "run")


def quantification_report(cells: DataFrame) -> DataFrame:
    """run, n_cells, n_detected, detection_rate and nearest-rank q of the detected target cells."""
    rows = cells.where("not decoy")
    counts = rows.groupBy("run").agg(F.count("*").alias("n_cells"), F.count_if(F.col("intensity") > 0).alias("n_detected"))
    found = at_shares(rows.where("intensity > 0"), ["run"], "q").drop("n")
    return counts.withColumn("detection_rate", F.col("n_detected") / F.col("n_cells")).join(found, "run", "left")


def as_json(report: DataFrame) -> Column:
    return F.to_json(F.struct(*report.columns))
