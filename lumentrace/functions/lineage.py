"""Cutting the plans of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """The session's ``spark.checkpoint.dir``; on a local master, where that is unset, a temporary folder."""
    session = df.sparkSession
    found = session.conf.get("spark.checkpoint.dir", None)
    if found is None and not session.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df))
    return df.checkpoint(eager=True)
