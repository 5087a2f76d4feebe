"""Spectra from mzML files; hills and features from and to TSV or Parquet; reports.

Tables are read through Spark's own readers; mzML files through ``sources.mzml``,
in byte ranges.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrace.operators.statistics import medians
from lumentrace.operators.tracking import channel_key
from lumentrace.sources import mzml

SPECTRA = (
    "run string, scan int, ms_level int, rt double, voltage double, iso_target double, iso_lower double, iso_upper double, "
    "peaks array<struct<mz:double,intensity:double,im:double>>"
)
#: Accessions of the format's controlled vocabulary.
LEVEL, TIME, SECONDS, PROFILE, VOLTAGE = "MS:1000511", "MS:1000016", "UO:0000010", "MS:1000128", "MS:1001581"
TARGET, LOWER, UPPER, SELECTED, LOWER_LIMIT, UPPER_LIMIT = "MS:1000827", "MS:1000828", "MS:1000829", "MS:1000744", "MS:1000794", "MS:1000793"
MZ, INTENSITY, MOBILITY = "MS:1000514", "MS:1000515", ("MS:1003006", "MS:1002816", "MS:1002893")
DOUBLE, ZLIB = "MS:1000523", "MS:1000574"
HILLS = "hill_id mz mz_std mz_se rt rt_start rt_end rt_width im im_std scan_start scan_apex scan_end n_scans skipped_scans intensity_sum intensity_max hill_score intensity_profile".split()


def run_name(path) -> F.Column:
    """A run's key from a path: no folders, and no format's endings."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?i)(\.(gz|mzml|raw|d))+$", "")


def name_of(path: str) -> str:
    """``run_name`` of one path."""
    return re.sub(r"(?i)(\.(gz|mzml|raw|d))+$", "", re.split(r"[/\\]", path)[-1])


def _params(element) -> dict[str, tuple[str, str]]:
    return {p.get("accession"): (p.get("value", ""), p.get("unitAccession", "")) for p in element.iter() if p.tag.endswith("cvParam")}


def _number(params, key) -> float | None:
    try:
        return float(params[key][0])
    except (KeyError, ValueError):
        return None


def _picked(mz: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Indices of a profile's local maxima: each is as high as the valleys beside it at least, a signal-to-noise of 1."""
    if len(value) < 3:
        return np.arange(len(value))
    return 1 + np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] >= value[2:]))


def _apexes(mz: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """m/z of the tops of parabolas through each local maximum and its two neighbours, whatever their spacing."""
    inner = (at > 0) & (at < len(mz) - 1)
    left, right = np.maximum(at - 1, 0), np.minimum(at + 1, len(mz) - 1)
    before, after = mz[at] - mz[left], mz[right] - mz[at]
    up, down = value[at] - value[left], value[at] - value[right]
    bend = after * up + before * down
    sound = inner & (before > 0) & (after > 0) & (bend > 0)
    return mz[at] + np.where(sound, (after**2 * up - before**2 * down) / np.where(sound, 2 * bend, 1.0), 0.0)


def level_of(element) -> int:
    level = _number(_params(element), LEVEL)
    return int(level) if level else 1


def spectrum_row(element, index: int) -> dict:
    """A row of SPECTRA's columns, but for the run."""
    params = _params(element)
    time, unit = params.get(TIME, ("0", ""))
    arrays = {}
    for held in (e for e in element.iter() if e.tag.endswith("binaryDataArray")):
        about = _params(held)
        raw = base64.b64decode("".join(next(e.text or "" for e in held if e.tag.endswith("binary")).split()))
        values = np.frombuffer(zlib.decompress(raw) if ZLIB in about else raw, "<f8" if DOUBLE in about else "<f4").astype(float)
        kind = "mz" if MZ in about else "value" if INTENSITY in about else "im" if any(m in about for m in MOBILITY) else None
        if kind:
            arrays[kind] = values
    mz, value = arrays.get("mz", np.zeros(0)), arrays.get("value", np.zeros(0))
    im = arrays.get("im", np.zeros(len(mz)))
    if PROFILE in params:
        keep = _picked(mz, value)
        mz, value, im = _apexes(mz, value, keep), value[keep], im[keep]
    keep = np.flatnonzero(value > 0)
    keep = keep[np.argsort(mz[keep], kind="stable")]
    low, high = _number(params, LOWER_LIMIT), _number(params, UPPER_LIMIT)
    target, lower, upper = (_number(params, k) for k in (TARGET, LOWER, UPPER))
    if target is not None and lower is not None and upper is not None:
        low, high = target - lower, target + upper
    target = target if target is not None else _number(params, SELECTED)
    windowed = any(e.tag.endswith("isolationWindow") for e in element.iter())
    if windowed and target is not None and (low is None or high is None or not low < high):
        low = high = target
    return {
        "scan": index, "ms_level": level_of(element), "rt": float(time or 0) / (60 if unit == SECONDS else 1), "voltage": _number(params, VOLTAGE),
        "iso_target": target if windowed else None, "iso_lower": low if windowed else None, "iso_upper": high if windowed else None,
        "peaks": [{"mz": a, "intensity": b, "im": c} for a, b, c in zip(mz[keep].tolist(), value[keep].tolist(), im[keep].tolist())],
    }


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    """Rows of SPECTRA's columns as Arrow."""
    kind = pa.struct([("mz", pa.float64()), ("intensity", pa.float64()), ("im", pa.float64())])
    types = {"run": pa.string(), "scan": pa.int32(), "ms_level": pa.int32(), "peaks": pa.list_(kind)}
    names = [c.split()[0] for c in SPECTRA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.float64())) for c in names], names)


def read_mzml(spark: SparkSession, path: str, level: int | None = None, split_bytes: int = 128 << 20) -> DataFrame:
    """SPECTRA's columns of a file or all files of a folder, in ranges of ``split_bytes`` (see ``sources.mzml``).

    ``scan`` is the place in the file, empty spectra included; spectra of other
    levels than ``level`` are not decoded.
    """
    mzml.register(spark)
    options = {"splitBytes": split_bytes} | ({} if level is None else {"level": level})
    return spark.read.format("mzml").options(**options).load(path)


def by_time(spectra: DataFrame) -> DataFrame:
    """Spectra of level 1 with peaks, ``scan`` numbered from 0 by time in each run, equal times by their places in the file."""
    rows = spectra.where((F.col("ms_level") == 1) & (F.size("peaks") > 0))
    nth = F.row_number().over(Window.partitionBy("run").orderBy("rt", "scan")) - 1  # over keys, without peaks
    places = rows.select("run", "scan", "rt").withColumn("nth", nth).select("run", "scan", "nth")
    return rows.join(places, ["run", "scan"]).withColumn("scan", F.col("nth")).select(*spectra.columns)


def voltage_in(text) -> F.Column:
    """The voltage that a text begins with, null where its first word is no finite number; minus zero is zero."""
    return channel_key(F.try_element_at(F.split(F.trim(text), r"\s+"), F.lit(1)).try_cast("double"))


def peaks(spectra: DataFrame, level: int = 1) -> DataFrame:
    """run, channel, scan, rt, mz, intensity, im of spectra with peaks; channels are voltages, at level 2 windows' bounds."""
    window = F.when(F.col("iso_target").isNotNull(), F.format_string("%.4f:%.4f", "iso_lower", "iso_upper"))
    channel = channel_key(F.col("voltage")) if level == 1 else window
    rows = spectra.where((F.col("ms_level") == level) & (F.size("peaks") > 0))
    if level == 2:
        rows = rows.where(F.col("iso_target").isNotNull())
    return rows.select("run", channel.alias("channel"), "scan", "rt", F.inline("peaks"))


def _written(rows: DataFrame, path: str, format: str) -> None:
    if format == "parquet":
        rows.write.parquet(path)
    else:
        rows.write.option("sep", "\t").option("header", True).option("nanValue", "NaN").csv(path)


def write_hills(hills: DataFrame, path: str, format: str = "parquet") -> None:
    """HILLS' columns (and window columns where there are any), the greatest intensity first; profiles as JSON lists."""
    extra = [c for c in ("run", "channel", "iso_target_mz", "iso_lower_mz", "iso_upper_mz") if c in hills.columns]
    rows = hills.withColumn("intensity_profile", F.to_json("profile")).select(*HILLS, *extra)
    _written(rows.orderBy(F.desc("intensity_sum"), "hill_id"), path, format)


def read_hills(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """What ``write_hills`` wrote, or any table with those columns: hill_id, mz_se and windows may lack."""
    rows = spark.read.parquet(path) if format == "parquet" else spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)
    whole = ("hill_id", "scan_start", "scan_apex", "scan_end", "n_scans", "skipped_scans")
    cast = lambda c: F.col(c).cast("long" if c == "hill_id" else "int" if c in whole else "double").alias(c)
    out = [cast(c) if c in rows.columns else F.lit(None).cast("long" if c == "hill_id" else "double").alias(c) for c in HILLS[:-1]]
    others = [c for c in rows.columns if c not in HILLS]
    return rows.select(*out, F.from_json("intensity_profile", "array<double>").alias("profile"), *others)


def write_features(features: DataFrame, path: str, format: str = "parquet") -> None:
    """Charged features, the greatest intensity first; lists as JSON."""
    lists = [f.name for f in features.schema.fields if f.dataType.typeName() == "array"]
    rows = features.where("charge > 0").withColumns({c: F.to_json(c) for c in lists})
    _written(rows.orderBy(F.desc("intensity_sum"), "mz"), path, format)


def read_features(spark: SparkSession, path: str, format: str = "parquet", c13: float = 1.0033548378) -> DataFrame:
    """Charged features with ``raw_mz``: the m/z before its neutron offset was taken off."""
    rows = spark.read.parquet(path) if format == "parquet" else spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)
    offset = F.col("neutron_offset") if "neutron_offset" in rows.columns else F.lit(0)
    return rows.where("charge > 0").withColumn("raw_mz", F.col("mz") + offset * c13 / F.col("charge"))


def report(features: DataFrame) -> DataFrame:
    """run, report: medians, spreads and numbers by charge of each run as JSON."""
    measures = [c for c in ("mz", "rt_apex", "intensity_sum", "n_isotopes", "cosine_score", "isotope_score", "ppm_error") if c in features.columns]
    values = features.select("run", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in measures])).alias("x")).select("run", "x.*").where("v is not null")
    middle = medians(values, ["run", "measure"], "v").groupBy("run").agg(*[F.max(F.when(F.col("measure") == c, F.col("median"))).alias(f"m_{c}") for c in measures])
    whole = features.groupBy("run").agg(F.count("*").alias("n_features"), *[F.stddev_samp(c).alias(f"s_{c}") for c in measures]).join(middle, "run", "left")
    each = F.struct(*[F.struct(F.col(f"m_{c}").alias("median"), F.col(f"s_{c}").alias("std")).alias(c) for c in measures])
    whole = whole.select("run", "n_features", each.alias("measures"))
    charges = features.groupBy("run", "charge").agg(F.count("*").alias("n")).groupBy("run").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("charge").cast("string"), "n")))).alias("charges"))
    return whole.join(charges, "run").select("run", F.to_json(F.struct("n_features", "measures", "charges")).alias("report"))


def read_identifications(spark: SparkSession, path: str, sage: bool = False, format: str = "tsv", min_rank: int = 1) -> DataFrame:
    """run, peptide, charge, mass, rt, q, im from a generic table or a Sage table; decoys and lower ranks go, bad rows are an error."""
    rows = spark.read.parquet(path) if format == "parquet" else spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    if sage:
        decoy = F.coalesce(has("is_decoy").cast("boolean"), has("label").cast("int") == -1, F.lit(False))
        rows = rows.where(~decoy & (F.coalesce(has("rank").cast("int"), F.lit(1)) <= min_rank))
        named = [run_name(F.col("filename")), F.col("peptide"), F.col("charge"), F.col("calcmass"), F.col("rt"), F.greatest("spectrum_q", "peptide_q"), has("ion_mobility")]
    else:
        named = [run_name(F.col("run")), F.col("modified_peptide"), F.col("charge"), F.col("neutral_mass"), F.col("rt_minutes"), F.col("id_qvalue"), has("im")]
    kinds = ("string", "string", "int", "double", "double", "double", "double")
    names = ("run", "peptide", "charge", "mass", "rt", "q", "im")
    out = rows.select(*[c.cast(k).alias(n) for c, k, n in zip(named, kinds, names)])
    sound = (F.col("charge") > 0) & (F.col("mass") > 0) & ~F.isnan("rt") & (F.col("rt") >= 0) & F.col("q").between(0, 1) & (F.trim("peptide") != "") & (F.trim("run") != "")
    message = F.concat(F.lit("bad identification: "), F.to_json(F.struct(*names)))
    return out.where(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def runs_in(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the runs' folders that hold both hills and features, by name; a row a file reaches the driver."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").distinct()
    both = listed.select(F.regexp_extract("path", r"^(.*)/(hills|features)[^/]*(/[^/]*)?$", 1).alias("run"), F.regexp_extract("path", r"/(hills|features)[^/]*(/[^/]*)?$", 1).alias("kind")).where("kind != ''")
    found = both.groupBy("run").agg(F.count_distinct("kind").alias("n")).where("n = 2")
    return sorted(r["run"] for r in found.collect())


