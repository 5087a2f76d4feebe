"""Traces of a stream whose scans may arrive in parts and out of order.

A scan waits in its channel's state until the watermark has passed its time, so
that all its peaks and all scans before it are there; what comes out is then what
``tracking.track`` gives on all peaks that the watermark let in.  ``tracks`` is the
variant that does not wait.

The state is in plain columns (WAITING, OPEN, PROGRESS), so it can be read
without this module.  It needs the state store of RocksDB: set
``spark.sql.streaming.stateStore.providerClass`` to ``STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from lumentrace.operators import tracking

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Peaks of scans that the watermark has not passed.
WAITING = "at long, scan int, mz double, intensity double, im double, rt double"
#: Traces that may go on.
OPEN = "number int, n int, mz_mean double, im_mean double, scans array<int>, rt array<double>, mz array<double>, value array<double>, im array<double>"
#: Traces begun so far, the last scan that was gone through, the latest time seen, the timer that is set.
PROGRESS = "number int, last int, latest long, timer long"
COLUMNS = [c.split()[0] for c in tracking.HILL.split(", ")]


def _opened(row) -> tracking._Trace:
    trace = tracking._Trace(row[0])
    trace.n, trace.mz_mean, trace.im_mean = row[1:4]
    trace.at, trace.rt, trace.mz, trace.values, trace.im = (list(x) for x in row[4:])
    return trace


def _kept(t: tracking._Trace) -> tuple:
    return (t.number, t.n, float(t.mz_mean), float(t.im_mean), t.at, t.rt, t.mz, t.values, t.im)


class Tracker(StatefulProcessor):
    """One channel's scans, in order; see the module."""

    def __init__(self, options: tracking.Tracking, silence_ms: int):
        self.options, self.silence = options, silence_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.open, self.progress = handle.getListState("waiting", WAITING), handle.getListState("open", OPEN), handle.getValueState("progress", PROGRESS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, last, latest, timer = self.progress.get() if self.progress.exists() else (0, -1, 0, 0)
        for part in rows:
            if part["scan"].min() <= last:
                raise ValueError(f"scan {part['scan'].min()} of {tuple(key)} comes at a later time than scan {last}: scans must rise with time")
            at = part["time"].astype("datetime64[us]").astype("int64") // 1000
            latest = max(latest, int(at.max()))
            self.waiting.appendList(list(zip(at.tolist(), *(part[c].tolist() for c in ("scan", "mz", "intensity", "im", "rt")))))
        yield from self._advance(key, (number, last, latest, timer), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, last, latest, _ = self.progress.get()
        yield from self._advance(key, (number, last, latest, 0), timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, progress, watermark: int) -> Iterator[pd.DataFrame]:
        number, last, latest, timer = progress
        peaks = [tuple(p) for p in self.waiting.get()]
        # A scan goes with its latest peak: its parts have one time in sound data.
        until = {}
        for p in peaks:
            until[p[1]] = max(p[0], until.get(p[1], 0))
        held = min((s for s, t in until.items() if t > watermark), default=None)
        due = [p for p in peaks if held is None or p[1] < held]
        still = [p for p in peaks if held is not None and p[1] >= held]
        ended = []
        if due or not still:
            active = [_opened(tuple(row)) for row in self.open.get()]
            scans = {}
            for _, scan, *peak in sorted(due, key=lambda p: p[1:4]):
                scans.setdefault(scan, []).append(tuple(peak))
            for scan, found in scans.items():
                active, over, number = tracking.step(active, scan, found, self.options, number)
                ended, last = ended + over, scan
            if not still and latest + self.silence <= watermark:
                ended, active = ended + active, []
            self.open.put([_kept(t) for t in active]) if active else self.open.clear()
            self.waiting.put(still) if still else self.waiting.clear()
        else:
            active = True
        if timer:
            self.handle.deleteTimer(timer)
        timer = until[held] if still else latest + self.silence if active else 0
        if timer:
            timer = max(timer, watermark + 1)
            self.handle.registerTimer(timer)
        # What remains of a silent channel is its last scan.
        self.progress.update((number, last, latest, timer))
        rows = [h for t in ended if (h := tracking._finished(t, self.options)) is not None]
        if rows:
            found = pd.DataFrame(rows, columns=COLUMNS)
            found.insert(0, "channel", key[1])
            found.insert(0, "run", key[0])
            yield found

    def close(self) -> None:
        pass


def track_settled(spectra: DataFrame, options: tracking.Tracking = tracking.Tracking(), delay: str = "1 minute", silence: timedelta = timedelta(minutes=5)) -> DataFrame:
    """run, channel, HILL's columns of a stream of ``tracking.track``'s columns and ``time``, the scan's event time.

    Peaks more than ``delay`` behind are Spark's late rows: dropped, and counted in
    the query's progress.  A scan that comes at a later time than one of a greater
    number that was gone through fails the query.  Traces that are open when a
    channel has been silent for ``silence`` end there.
    """
    kinds = ", ".join(f"{c} {spectra.schema[c].dataType.simpleString()}" for c in ("run", "channel"))
    rows = spectra.where((F.col("intensity") > 0) & (F.col("mz") > 0)).withColumn("im", F.coalesce("im", F.lit(0.0)).cast("double"))
    rows = rows.select("run", "channel", F.col("scan").cast("int").alias("scan"), *[F.col(c).cast("double").alias(c) for c in ("rt", "mz", "intensity")], "im", "time").withWatermark("time", delay)
    tracker = Tracker(options, int(silence.total_seconds() * 1000))
    return rows.groupBy("run", "channel").transformWithStateInPandas(tracker, f"{kinds}, {tracking.HILL}", "append", "EventTime")
