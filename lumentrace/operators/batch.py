"""From mzML files of many runs to hills, features, quantities and their files, each step written before the next reads it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.operators import chains, drivers, reports, tracking
from lumentrace.operators import statistics as st
from lumentrace.sources import files


@dataclass(frozen=True)
class Processing:
    """Settings from spectra to features; steps that are 0, None or False are left out."""

    tracking: tracking.Tracking = field(default_factory=tracking.Tracking)
    chains: chains.Chains = field(default_factory=chains.Chains)
    #: Scans of the rolling median that a scan's intensities are scaled to, whether of medians in place of sums.
    window: int = 0
    by_median: bool = False
    clip: float = 0.0
    #: Settings of the cut at valleys.
    split: dict | None = None
    #: Scans from which on a hill may be a baseline.
    baseline: int = 0
    recalibrate: bool = True
    sulfur: tuple[int, ...] = (-1, 0, 1)
    decoy: bool = False
    #: Settings of the second level that differ from ``tracking``'s; None leaves fragments out.
    fragments: dict | None = None


def hills_of(peaks: DataFrame, o: Processing = Processing(), level: int = 1) -> DataFrame:
    """Numbered hills of ``peaks`` (run, channel, scan, rt, mz, intensity, im)."""
    if o.window and level == 1:
        peaks = tracking.normalised_scans(peaks, o.window, median=o.by_median)
    if o.decoy and level == 1:
        peaks = tracking.shuffled_scans(peaks)
    if o.clip:
        peaks = tracking.clip_noise(peaks, o.clip)
    found = tracking.track(peaks, tracking.options_for(level, o.tracking, **(o.fragments or {})))
    if o.split is not None:
        found = tracking.split(found, **o.split)
    if o.baseline:
        found = tracking.without_baselines(found, o.baseline)
    return tracking.numbered(found)


def catalogue(features: DataFrame) -> DataFrame:
    """run, feature_id, mz, charge, rt, im, score of ``drivers.find_features``'s rows, as ``drivers.quantify`` takes them."""
    return features.select("run", F.xxhash64("channel", "seed", "charge").alias("feature_id"), "mz", "charge", F.col("rt_apex").alias("rt"), F.col("im"), F.col("combined_score").alias("score"))


def process(spark: SparkSession, path: str, folder: str, o: Processing = Processing()) -> dict[str, DataFrame]:
    """hills, features (and fragments: hills of the second level) of all mzML files at ``path``, written to ``folder`` and read from there.

    Features of shuffled scans are not recalibrated.
    """
    spectra = files.read_mzml(spark, path, level=1)
    hills_of(files.peaks(files.by_time(spectra)), o).write.mode("overwrite").parquet(f"{folder}/hills")
    hills = spark.read.parquet(f"{folder}/hills")
    found, _ = drivers.find_features(hills, o.chains, recalibrate=o.recalibrate and not o.decoy, sulfur=o.sulfur)
    found.write.mode("overwrite").parquet(f"{folder}/features")
    out = {"hills": hills, "features": spark.read.parquet(f"{folder}/features")}
    if o.fragments is not None:
        second = files.peaks(files.read_mzml(spark, path, level=2), 2)
        hills_of(second, o, 2).write.mode("overwrite").parquet(f"{folder}/fragments")
        out["fragments"] = spark.read.parquet(f"{folder}/fragments")
    return out


def study(spark: SparkSession, path: str, folder: str, o: Processing = Processing(), s: drivers.Study = drivers.Study(), reference: str | None = None) -> dict[str, DataFrame]:
    """``process``, ``drivers.quantify`` and its matrices, all written to ``folder``: cells, groups, factors, intensity, q, decoy, consensus, report.

    Without a ``reference`` it is the run of most features.
    """
    made = process(spark, path, folder, o)
    features = catalogue(made["features"])
    reference = reference or st.reference_run(features.withColumn("value", F.col("score")), 0).first()["run"]
    found = drivers.quantify(features, made["hills"], reference, s)
    for name, table in found.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    found = {name: spark.read.parquet(f"{folder}/{name}") for name in found}
    runs = st.run_names(found["cells"].select("run"))
    wide = drivers.matrices(found, runs, s.most_q) | {"report": reports.quantification_report(found["cells"])}
    for name, table in wide.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    return made | found | {name: spark.read.parquet(f"{folder}/{name}") for name in wide}
