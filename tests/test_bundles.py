"""Bundles: the manifest stands for whole tables only."""

import os

import pytest
from pyspark.sql import functions as F

from lumentrace.sources import bundles


def test_write_and_read(spark, tmp_path):
    source, folder = str(tmp_path / "source"), str(tmp_path / "out")
    spark.range(100).write.parquet(source)
    tables = {"cells": spark.range(50, numPartitions=3), "observations": spark.range(7).withColumn("x", F.col("id") * 2)}
    manifest = bundles.write(folder, tables, {"features": source}, {"reference": "a"})
    assert manifest["tables"]["cells"]["n_parts"] == 3 and manifest["reference"] == "a"
    again, read = bundles.read(spark, folder)
    assert again == manifest and read["cells"].count() == 50 and read["observations"].columns == ["id", "x"]
    # Another table in its place is noticed; other parts of the same name are too.
    spark.range(51).write.mode("overwrite").parquet(f"{folder}/cells")
    with pytest.raises(ValueError, match="cells"):
        bundles.read(spark, folder)


def test_broken_writes_leave_no_manifest(spark, tmp_path):
    source, folder = str(tmp_path / "source"), str(tmp_path / "out")
    spark.range(10).write.parquet(source)
    bundles.write(folder, {"cells": spark.range(5)}, {"features": source})
    broken = spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        bundles.write(folder, {"cells": broken}, {"features": source})
    assert not os.path.exists(f"{folder}/{bundles.MANIFEST}")


def test_changed_sources_are_refused(spark, tmp_path, monkeypatch):
    source, folder = str(tmp_path / "source"), str(tmp_path / "out")
    spark.range(10).write.parquet(source)
    seen, digest = [], bundles.digest

    def changing(session, path):
        if path == source:
            seen.append(path)
            if len(seen) == 2:
                spark.range(1).write.mode("append").parquet(source)
        return digest(session, path)

    monkeypatch.setattr(bundles, "digest", changing)
    with pytest.raises(ValueError, match="features"):
        bundles.write(folder, {"cells": spark.range(5)}, {"features": source})
    assert not os.path.exists(f"{folder}/{bundles.MANIFEST}")


def test_observations_keep_every_feature(spark):
    features = spark.createDataFrame([("a", 1, 2, 0.9), ("a", 2, 2, 0.8), ("b", 1, 2, 0.7), ("b", 2, 0, 0.7), ("b", 3, 2, float("nan")), ("b", 4, 2, 0.1)], "run string, feature_id long, charge int, score double")
    kind = "group_id string, members array<struct<run:string,feature_id:long>>, primaries array<struct<run:string,feature_id:long>>"
    groups = spark.createDataFrame([("a:1", [("a", 1), ("a", 2), ("b", 1)], [("a", 1), ("b", 1)])], kind)
    got = {(r.run, r.feature_id): (r.group_id, r.is_primary, r.is_seed, r.reason) for r in bundles.observations(features, groups).collect()}
    assert got == {
        ("a", 1): ("a:1", True, True, None), ("a", 2): ("a:1", False, False, None), ("b", 1): ("a:1", True, False, None), ("b", 2): (None, False, False, "unknown_charge"),
        ("b", 3): (None, False, False, "invalid_feature_score"), ("b", 4): (None, False, False, "group_confidence_or_singleton"),
    }
