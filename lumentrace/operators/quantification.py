"""Extracted signal of cells (a group in a run, or its decoy), scored and integrated.

``cells`` rows are cell_id, run, decoy, mz, charge, rt, im, template (isotope
shares); ``hills`` as from ``tracking.track``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumentrace.functions.lineage import cut_lineage
from lumentrace.functions.profiles import segments
from lumentrace.operators import statistics as st
from lumentrace.operators.isotopes import NEUTRON


@dataclass(frozen=True)
class Extraction:
    ppm: float = 10.0
    half_window: float = 0.5
    im_tolerance: float = 0.05
    n_isotopes: int = 3
    columns: int = 25
    least_pattern: float = 0.5
    #: Share of half the columns that a peak may reach to each side.
    reach: float = 0.5
    lone: float = 0.5
    #: hybrid, or one of rt, intensity, pattern.
    score: str = "hybrid"
    #: sum over the peak, or apex.
    estimator: str = "sum"
    #: Whether intensities are what lies along the template.
    projected: bool = False


SCANS_A_COLUMN, LEAST_COLUMNS = 2.0, 6


def scan_spacing(hills: DataFrame) -> DataFrame:
    """run, spacing: the upper median of the time from scan to scan over hills of three scans or more."""
    rows = hills.where((F.col("scan_end") - F.col("scan_start") >= 2) & (F.col("rt_end") > F.col("rt_start")))
    spacing = (F.col("rt_end") - F.col("rt_start")) / (F.col("scan_end") - F.col("scan_start"))
    return st.medians(rows.select("run", spacing.alias("spacing")), ["run"], "spacing", upper=True).select("run", F.col("median").alias("spacing"))


def columns_for(hills: DataFrame, o: Extraction = Extraction(), scans_a_column: float = SCANS_A_COLUMN, least: int = LEAST_COLUMNS) -> DataFrame:
    """run, columns: as many as the window holds at the run's scan spacing, within limits."""
    wanted = F.round(2 * o.half_window / (scans_a_column * F.col("spacing")))
    each = hills.select("run").distinct().join(scan_spacing(hills), "run", "left")
    return each.select("run", F.coalesce(F.greatest(F.lit(least), F.least(F.lit(o.columns), wanted)), F.lit(o.columns)).cast("int").alias("columns"))


def sample_rt(hill_start, hill_end, n, i) -> Column:
    """Time of the i-th scan of a profile of ``n``, on a line from its first to its last."""
    return F.when(n <= 1, hill_start).otherwise(hill_start + (hill_end - hill_start) * i / (n - 1))


def grids(cells: DataFrame, hills: DataFrame, o: Extraction = Extraction(), first: int = 0) -> DataFrame:
    """cell_id, run, decoy, iso, grid (sums by time column), winner_mz, winner_im (of the most intense hill) of rows with signal.

    Isotopes from ``first`` (-1 for the one before).  An equi-join on m/z bins
    of the tolerance's width and slices of the window's width brings cells and
    hills together; a pair counts in the first slice that both are in.
    """
    wide = 2 * o.half_window
    at = lambda mz: F.floor(F.log(mz) / math.log1p(o.ppm * 1e-6))
    slices = lambda a, b: F.explode(F.sequence(F.floor(a / wide), F.floor(b / wide)))
    asked = cells.select("cell_id", "run", "decoy", "rt", "im", "mz", "charge", F.explode(F.sequence(F.lit(first), F.lit(o.n_isotopes - 1))).alias("iso"))
    asked = asked.withColumn("target", F.col("mz") + F.col("iso") * NEUTRON / F.col("charge")).withColumn("slice", slices(F.col("rt") - o.half_window, F.col("rt") + o.half_window))
    asked = asked.withColumn("bin", F.explode(F.array(*[at(F.col("target")) + k for k in (-1, 0, 1)])))
    names = ["mz", "im", "rt_start", "rt_end", "intensity_sum", "profile"]
    held = hills.select("run", F.struct(*names).alias("h"), at(F.col("mz")).alias("bin"), slices(F.col("rt_start"), F.col("rt_end")).alias("slice"))
    h, low = F.col("h"), F.col("rt") - o.half_window
    near = (F.abs(h.mz - F.col("target")) <= F.col("target") * o.ppm * 1e-6) & (h.rt_end >= low) & (h.rt_start <= F.col("rt") + o.half_window)
    near = near & (F.col("slice") == F.floor(F.greatest(low, h.rt_start) / wide)) & ((F.col("im") == 0) | (h.im == 0) | (F.abs(h.im - F.col("im")) <= o.im_tolerance))
    pairs = asked.join(held, ["run", "bin", "slice"]).where(near)
    each = pairs.select("cell_id", "run", "decoy", "iso", low.alias("low"), h.mz.alias("mz"), h.im.alias("im"), h.intensity_sum.alias("whole"), h.rt_start.alias("a"), h.rt_end.alias("b"), F.size(h.profile).alias("n"), F.posexplode(h.profile).alias("i", "v"))
    share = (sample_rt(F.col("a"), F.col("b"), F.col("n"), F.col("i")) - F.col("low")) / wide
    each = each.withColumn("share", share).where((F.col("v") > 0) & (F.col("share") >= 0) & (F.col("share") < 1))
    keys = ["cell_id", "run", "decoy", "iso"]
    sums = each.groupBy(*keys, F.floor(F.col("share") * o.columns).cast("int").alias("col")).agg(F.sum("v").alias("v"), F.max(F.struct("whole", (-F.col("mz")).alias("low"), "mz", "im")).alias("w"))
    rows = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("cols"), F.max("w").alias("w"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(o.columns - 1)), lambda c: F.coalesce(F.try_element_at("cols", c), F.lit(0.0)))
    return rows.select(*keys, grid.alias("grid"), F.col("w.mz").alias("winner_mz"), F.col("w.im").alias("winner_im"))


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(min(1.0, max(0.0, a @ b / n))) if n > 0 else 0.0


def measured(grid: np.ndarray, template: np.ndarray, o: Extraction, rt_sigma: float | None = None) -> dict:
    """Scores and peak of one cell's grid (isotopes by columns).

    ``template`` is a whole isotope distribution: what it has beyond the grid's
    rows lowers the pattern's score.  With ``rt_sigma`` (in columns) closeness
    in time is a Gaussian.
    """
    n, columns = grid.shape
    head = template[:n]
    covered = min(1.0, float(head.sum())) if head.sum() > 0 else 0.0
    share = head / head.sum() if head.sum() > 0 else np.full(n, 1 / n)
    totals = grid.sum(axis=0)
    apex = columns - 1 - int(np.argmax(totals[::-1]))
    if totals[apex] <= 0:
        return {"intensity": 0.0, "apex_intensity": 0.0, "apex": -1, "start": -1, "end": -1, "hybrid": 0.0, "pattern": 0.0, "rt_score": 0.0, "intensity_score": 0.0, "coelution": 0.0, "n_found": 0}
    later = [(share[k], _cosine(grid[0], grid[k])) for k in range(1, n) if share[k] > 0 and grid[k].any()]
    coelution = sum(w * c for w, c in later) / sum(w for w, _ in later) if later else o.lone
    middle = (columns - 1) / 2
    if rt_sigma is not None and rt_sigma > 0:
        rt = np.exp(-0.5 * ((np.arange(columns) - middle) / rt_sigma) ** 2)
    else:
        rt = 1 - np.cbrt(np.abs(np.arange(columns) - middle) / middle) if middle > 0 else np.ones(columns)
    strength = np.sqrt(totals / totals.max())
    pattern = covered * np.where(totals > 0, np.sqrt(grid * share[:, None]).sum(axis=0) / np.sqrt(np.where(totals > 0, totals, 1.0)), 0.0)
    hybrid = {"rt": rt, "intensity": strength, "pattern": pattern}.get(o.score)
    if hybrid is None:
        hybrid = np.maximum(0.0, rt * strength * pattern * coelution) ** 0.25
    start = end = apex
    steps = max(1, math.ceil(o.reach * columns / 2))
    fits = lambda c: pattern[c] >= o.least_pattern and hybrid[c] >= hybrid[apex] / 2
    while start > 0 and apex - start < steps and fits(start - 1):
        start -= 1
    while end + 1 < columns and end - apex < steps and fits(end + 1):
        end += 1
    value = totals
    if o.projected and np.linalg.norm(share) > 0:  # what lies along the template
        value = share @ grid / np.linalg.norm(share)
    return {
        "intensity": float(value[start : end + 1].sum()), "apex_intensity": float(value[apex]), "apex": apex, "start": start, "end": end, "hybrid": float(hybrid[apex]), "pattern": float(pattern[apex]),
        "rt_score": float(rt[apex]), "intensity_score": float(strength[apex]), "coelution": float(coelution), "n_found": int(grid.any(axis=1).sum()),
    }


MEASURES = "intensity double, apex_intensity double, apex int, start int, end int, hybrid double, pattern double, rt_score double, intensity_score double, coelution double, n_found int, preceding double, observed_mz double, observed_im double"


@dataclass
class Samples:
    """The positive samples in a cell's window, one entry for each isotope row they are in."""

    iso: np.ndarray
    col: np.ndarray
    hill: np.ndarray
    place: np.ndarray
    seg: np.ndarray
    value: np.ndarray
    #: Hills in the order of m/z: isotope, id, m/z, mobility, whole intensity.
    hills: list[tuple]

    @classmethod
    def of(cls, cell: dict) -> Samples:
        low, wide, columns = cell["rt"] - cell["half_window"], 2 * cell["half_window"], int(cell["columns"])
        parts, hills = [], []
        for t in sorted(cell["traces"] if cell["traces"] is not None else [], key=lambda t: (t["iso"], t["mz"], t["hill_id"])):
            v = np.asarray(t["profile"], float)
            times = t["rt_start"] + (t["rt_end"] - t["rt_start"]) * np.arange(len(v)) / max(1, len(v) - 1) if len(v) > 1 else np.array([t["rt"]])
            if t["times"] is not None:
                times = np.asarray(t["times"], float)
            share = (times - low) / wide if wide > 0 else np.full(len(v), -1.0)
            at = np.flatnonzero((v > 0) & np.isfinite(v) & (share >= 0) & (share < 1))
            seg = np.searchsorted(np.asarray(t["ends"], int), at, side="right")
            parts.append((np.full(len(at), t["iso"]), np.minimum(columns - 1, (share[at] * columns).astype(int)), np.full(len(at), t["hill_id"]), at, seg, v[at]))
            hills.append((t["iso"], t["hill_id"], t["mz"], t["im"], t["intensity_sum"]))
        whole = [np.concatenate(x) for x in zip(*parts)] if parts else [*(np.zeros(0, np.int64) for _ in range(5)), np.zeros(0)]
        return cls(*whole, hills)

    def grid(self, rows: range, columns: int, keep: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), columns))
        inside = keep & (self.iso >= rows.start) & (self.iso < rows.stop)
        np.add.at(out, (self.iso[inside] - rows.start, self.col[inside]), self.value[inside])
        return out


def counts(cell: dict, found: dict) -> bool:
    """Inferred cells need two isotopes that elute together."""
    return not cell.get("inferred") or (found["n_found"] >= 2 and found["coelution"] >= 0.5)


def extracted(samples: Samples, cell: dict, o: Extraction, keep: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    """Measures of a cell from the samples to ``keep``, and which samples its peak is made of."""
    columns, keep = int(cell["columns"]), np.ones(len(samples.iso), bool) if keep is None else keep
    grid = samples.grid(range(0, o.n_isotopes), columns, keep)
    found = measured(grid, np.asarray(cell["template"], float), o, cell["rt_sigma"])
    if o.estimator == "apex":
        found["intensity"] = found["apex_intensity"]
    found |= {"preceding": 0.0, "observed_mz": None, "observed_im": None}
    peak = keep & (samples.iso >= 0) & (samples.col >= found["start"]) & (samples.col <= found["end"]) & (found["apex"] >= 0)
    if found["apex"] >= 0:
        before, inside = samples.grid(range(-1, 0), columns, keep)[0], slice(found["start"], found["end"] + 1)
        held, total = before[inside].sum(), grid[:, inside].sum()
        found["preceding"] = float(_cosine(before, grid[0]) * held / (held + total)) if held > 0 else 0.0
        best, seen = 0.0, set(samples.hill[keep & (samples.iso == 0)].tolist())
        for iso, hill, mz, im, whole in samples.hills:  # the first of equally intense ones
            if iso == 0 and hill in seen and whole > best:
                best, found["observed_mz"], found["observed_im"] = whole, mz, im
    if not counts(cell, found):
        found["intensity"], peak = 0.0, peak & False
    return found, peak


def apex_time(found: dict, cell: dict) -> float:
    return cell["rt"] - cell["half_window"] + (found["apex"] + 0.5) * 2 * cell["half_window"] / cell["columns"]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _segment_ends(profiles: pd.Series) -> pd.Series:
    return profiles.map(lambda p: [end for _, end in segments(np.asarray(p, float))])


def _defaults(cells: DataFrame, o: Extraction) -> DataFrame:
    """``cells`` with half_window, columns and rt_sigma; ``o``'s where they have none."""
    have = lambda c, none, kind: F.coalesce(F.col(c), F.lit(none)).cast(kind) if c in cells.columns else F.lit(none).cast(kind)
    return cells.withColumns({"half_window": have("half_window", o.half_window, "double"), "columns": have("columns", o.columns, "int"), "rt_sigma": have("rt_sigma", None, "double")})


def traced(cells: DataFrame, hills: DataFrame, o: Extraction = Extraction()) -> DataFrame:
    """``cells`` with ``traces``: the hills at each isotope (from -1, the one before) in reach, with the ends of their native segments.

    Ids of cells and hills are joined by m/z bins of the tolerance's width and
    slices of the window's; profiles follow for the pairs that are near.
    """
    cells = _defaults(cells, o)
    wide = 2 * o.half_window
    at = lambda mz: F.floor(F.log(mz) / math.log1p(o.ppm * 1e-6))
    slices = lambda a, b: F.explode(F.sequence(F.floor(a / wide), F.floor(b / wide)))
    low, high = F.col("rt") - F.col("half_window"), F.col("rt") + F.col("half_window")
    asked = cells.select("cell_id", "run", "decoy", low.alias("low"), high.alias("high"), "im", F.explode(F.sequence(F.lit(-1), F.lit(o.n_isotopes - 1))).alias("iso"), "mz", "charge")
    asked = asked.withColumn("target", F.col("mz") + F.col("iso") * NEUTRON / F.col("charge")).drop("mz", "charge").withColumn("slice", slices(F.col("low"), F.col("high")))
    asked = asked.withColumn("bin", F.explode(F.array(*[at(F.col("target")) + k for k in (-1, 0, 1)])))
    names = hills.select("run", "hill_id", F.col("mz").alias("h_mz"), F.col("im").alias("h_im"), F.col("rt_start").alias("a"), F.col("rt_end").alias("b"), at(F.col("mz")).alias("bin"), slices(F.col("rt_start"), F.col("rt_end")).alias("slice"))
    near = (F.abs(F.col("h_mz") - F.col("target")) <= F.col("target") * o.ppm * 1e-6) & (F.col("b") >= F.col("low")) & (F.col("a") <= F.col("high"))
    near = near & (F.col("slice") == F.floor(F.greatest("low", "a") / wide)) & ((F.col("im") == 0) | (F.col("h_im") == 0) | (F.abs(F.col("h_im") - F.col("im")) <= o.im_tolerance))
    pairs = asked.join(names, ["run", "bin", "slice"]).where(near).select("cell_id", "run", "decoy", "iso", "hill_id")
    time = F.col("rt") if "rt" in hills.columns else (F.col("rt_start") + F.col("rt_end")) / 2
    times = F.col("times") if "times" in hills.columns else F.lit(None).cast("array<double>")
    trace = F.struct("hill_id", "mz", "im", time.alias("rt"), "rt_start", "rt_end", "intensity_sum", F.col("profile").cast("array<double>").alias("profile"), times.alias("times"), _segment_ends("profile").alias("ends"))
    rows = pairs.join(hills.select("run", "hill_id", trace.alias("t")), ["run", "hill_id"]).groupBy("cell_id", "run", "decoy").agg(F.collect_list(F.struct("iso", "t.*")).alias("traces"))
    return cells.join(rows, ["cell_id", "run", "decoy"], "left")


def timed(found: DataFrame, o: Extraction) -> DataFrame:
    """``found`` with its peak's times: rt_apex, rt_first, rt_last (middles of columns), peak_width."""
    column = 2 * F.col("half_window") / F.col("columns")
    time = lambda c: F.when(F.col("apex") >= 0, F.col("rt") - F.col("half_window") + (F.col(c) + 0.5) * column)
    width = F.when(F.col("apex") >= 0, (F.col("end") - F.col("start") + 1) * column).otherwise(0.0)
    return found.withColumns({"rt_apex": time("apex"), "rt_first": time("start"), "rt_last": time("end"), "peak_width": width})


def quantified(cells: DataFrame, hills: DataFrame, o: Extraction = Extraction()) -> DataFrame:
    """``cells`` with MEASURES and peak times, each as if it were alone; nothing found is 0.

    ``preceding`` is the penalty for signal one neutron before: its cosine with
    the first isotope times its share of both under the peak.  ``cells`` may
    have their own half_window, columns, rt_sigma and ``inferred``.
    """
    held = traced(cells, hills, o)

    def measure(batches):
        for part in batches:
            out = [extracted(Samples.of(cell), cell, o)[0] for cell in part.to_dict("records")]
            found = pd.DataFrame(out, index=part.index, columns=[c.split()[0] for c in MEASURES.split(", ")])
            yield pd.concat([part.drop(columns="traces"), found], axis=1)

    kept = [f for f in held.schema.fields if f.name != "traces"]
    return timed(held.mapInPandas(measure, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + MEASURES), o)


def q_by_class(rows: DataFrame, classes: list[str], conservative: bool = False) -> DataFrame:
    """``target_decoy_q`` within each evidence class (transferred, direct, inferred ...), a handful."""
    parts = [st.target_decoy_q(rows.where(F.col("evidence") == c), conservative).withColumn("evidence", F.lit(c)) for c in classes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matrices(found: DataFrame, runs: list[str]) -> dict[str, DataFrame]:
    """Wide tables by group: intensity (0 where missing), q (1) and decoy intensity (0), with a column for each run."""
    wide = lambda rows, value, none: rows.groupBy("group").pivot("run", runs).agg(F.first(value)).na.fill(none)
    targets, decoys = found.where("not decoy"), found.where("decoy")
    return {"intensity": wide(targets, "intensity", 0.0), "q": wide(targets, "q", 1.0), "decoy": wide(decoys, "intensity", 0.0)}


def detections(found: DataFrame, most_q: float = 0.05) -> DataFrame:
    """run, n_cells, n_found, n_confident of the target cells."""
    has = F.col("intensity") > 0
    return found.where("not decoy").groupBy("run").agg(F.count("*").alias("n_cells"), F.count_if(has).alias("n_found"), F.count_if(has & (F.col("q") <= most_q)).alias("n_confident"))


def details(found: DataFrame) -> DataFrame:
    """Long table with residuals in ppm, mobility and time; decoys carry their target's q."""
    paired = F.max(F.when(~F.col("decoy"), F.col("q"))).alias("target_q")
    q = found.groupBy("group", "run").agg(paired)
    rows = found.join(q, ["group", "run"])
    return rows.withColumns({
        "q": F.coalesce(F.when(F.col("decoy"), F.col("target_q")).otherwise(F.col("q")), F.lit(1.0)), "mz_ppm": (F.col("observed_mz") - F.col("mz")) / F.col("mz") * 1e6,
        "im_residual": F.when((F.col("im") != 0) & (F.col("observed_im") != 0), F.col("observed_im") - F.col("im")), "rt_residual": F.col("rt_apex") - F.col("rt"),
    }).drop("target_q")
