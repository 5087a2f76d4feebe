"""A bundle of long tables with a manifest that is there only when all of them are whole.

The manifest goes first and comes back last, by renaming, so a write that
breaks off leaves none.  Files are hashed by the tasks that read them, part by
part; a table's digest is that of its sorted parts' digests.  Sources are hashed
before and after, and a source that changed meanwhile is an error.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


def _at(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def digest(spark: SparkSession, path: str) -> dict:
    """sha256, n_parts and n_bytes of a file or a folder's data files; a row a part is sorted, none reaches the driver."""
    files = spark.read.format("binaryFile").load(path)
    parts = files.where(~F.element_at(F.split("path", "/"), -1).rlike("^[._]")).select(F.sha2("content", 256).alias("sha"), "length")
    row = parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha")), "\n").cast("binary"), 256).alias("sha256"), F.count("*").alias("n_parts"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes")).first()
    return row.asDict()


def write(folder: str, tables: dict[str, DataFrame], sources: dict[str, str], more: dict | None = None) -> dict:
    """Writes each table as Parquet below ``folder`` and then the manifest: digests of tables and sources, and ``more``."""
    spark = next(iter(tables.values())).sparkSession
    place, system = _at(spark, f"{folder}/{MANIFEST}")
    system.delete(place, False)
    before = {name: digest(spark, path) for name, path in sources.items()}
    held = {}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        held[name] = {"path": name, "columns": table.columns} | digest(spark, f"{folder}/{name}")
    changed = [name for name, path in sources.items() if digest(spark, path) != before[name]]
    if changed:
        raise ValueError(f"changed while they were exported: {', '.join(changed)}")
    manifest = (more or {}) | {"tables": held, "sources": {name: {"path": path} | before[name] for name, path in sources.items()}}
    draft, _ = _at(spark, f"{folder}/{MANIFEST}.tmp")
    stream = system.create(draft, True)
    stream.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True).encode()))
    stream.close()
    if not system.rename(draft, place):
        raise OSError(f"{place.toString()} could not be put in place")
    return manifest


def read(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and its tables; an error where there is none or a table's digest is another."""
    manifest = json.loads(spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()[0])
    for name, held in manifest["tables"].items():
        if digest(spark, f"{folder}/{held['path']}")["sha256"] != held["sha256"]:
            raise ValueError(f"{name} is not what the manifest says")
    return manifest, {name: spark.read.parquet(f"{folder}/{held['path']}") for name, held in manifest["tables"].items()}


def observations(features: DataFrame, groups: DataFrame) -> DataFrame:
    """``features`` (run, feature_id, charge, score ...) with group_id, is_primary (its run's best there), is_seed, and reason where it is in none.

    ``groups`` are those that stand, with ``members`` by group: run and feature_id in ``primaries`` and group_id as the seed's run and feature.
    """
    members = groups.select("group_id", F.explode("members").alias("m")).select("group_id", "m.run", "m.feature_id")
    best = groups.select("group_id", F.explode("primaries").alias("p")).select("group_id", "p.run", "p.feature_id", F.lit(True).alias("is_primary"))
    rows = features.join(members, ["run", "feature_id"], "left").join(best, ["group_id", "run", "feature_id"], "left")
    lost = F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf"))
    reason = F.when(F.col("group_id").isNotNull(), F.lit(None)).when(F.col("charge") == 0, "unknown_charge").when(lost, "invalid_feature_score").otherwise("group_confidence_or_singleton")
    seed = F.coalesce(F.concat_ws(":", F.col("run"), F.col("feature_id").cast("string")) == F.col("group_id"), F.lit(False))
    return rows.select(*features.columns, "group_id", F.coalesce("is_primary", F.lit(False)).alias("is_primary"), seed.alias("is_seed"), reason.cast("string").alias("reason"))
