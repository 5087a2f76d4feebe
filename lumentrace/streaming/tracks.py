"""Traces of a stream of scans: open traces are the state of a run's channel.

``spectra`` as for ``tracking.track``, with ``time``, the scan's event time.
A trace comes out as soon as a scan shows that it ended (append mode), what is
open when a channel falls silent comes out once the watermark passes its last
scan.  All peaks of a scan must arrive together; scans that come after a later
one of their channel was handled are dropped, as are those behind the watermark.
"""

from __future__ import annotations

import pickle
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumentrace.operators import tracking


def track_stream(spectra: DataFrame, options: tracking.Tracking = tracking.Tracking(), delay: str = "1 minute", silence: timedelta = timedelta(minutes=5)) -> DataFrame:
    """run, channel, HILL's columns; a failed read fails the query, nothing is skipped."""
    kinds = ", ".join(f"{c} {spectra.schema[c].dataType.simpleString()}" for c in ("run", "channel"))
    names = [c.split()[0] for c in tracking.HILL.split(", ")]
    rows = spectra.where((F.col("intensity") > 0) & (F.col("mz") > 0)).withColumn("im", F.coalesce("im", F.lit(0.0)).cast("double")).withWatermark("time", delay)

    def advance(key, batches, state: GroupState):
        def out(traces):
            found = pd.DataFrame([h for t in traces if (h := tracking._finished(t, options)) is not None], columns=names)
            found.insert(0, "channel", key[1])
            found.insert(0, "run", key[0])
            return found

        active, number, last = pickle.loads(state.get[0]) if state.exists else ([], 0, -1)
        if state.hasTimedOut:
            state.remove()
            yield out(active)
            return
        fresh = pd.concat(list(batches))
        fresh = fresh[fresh["scan"] > last].sort_values(["scan", "mz", "intensity"], kind="stable")
        done = []
        for scan, part in fresh.groupby("scan", sort=True):
            peaks = list(zip(part["mz"].tolist(), part["intensity"].tolist(), part["im"].tolist(), part["rt"].tolist()))
            active, ended, number = tracking.step(active, int(scan), peaks, options, number)
            done += ended
            last = int(scan)
        state.update((pickle.dumps((active, number, last)),))
        if len(fresh):
            until = max(int(fresh["time"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(silence.total_seconds() * 1000)
            state.setTimeoutTimestamp(until)
        yield out(done)

    grouped = rows.groupBy("run", "channel")
    return grouped.applyInPandasWithState(advance, f"{kinds}, {tracking.HILL}", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(spectra: DataFrame, gap: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """run, channel, start, end, n_scans, intensity of stretches of scans without a pause of ``gap``."""
    rows = spectra.withWatermark("time", delay)
    found = rows.groupBy("run", "channel", F.session_window("time", gap).alias("w")).agg(F.approx_count_distinct("scan").alias("n_scans"), F.sum("intensity").alias("intensity"))
    return found.select("run", "channel", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_scans", "intensity")
