"""Run-level statistics: rolling normalisation, isotope counts, alignment, q-values, matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.functions.lineage import cut_lineage


def rolling_scale(rows: DataFrame, window: int = 11, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """Centred rolling median of a channel over its value, clamped; a value of 0 gets the greatest scale."""
    half = window // 2
    near = F.sort_array(F.collect_list("value").over(Window.partitionBy("channel").orderBy("seq").rowsBetween(-half, half)))
    n = F.size(near)
    median = (F.element_at(near, (F.floor((n + 1) / 2)).cast("int")) + F.element_at(near, (F.floor(n / 2) + 1).cast("int"))) / 2
    scale = F.when(F.col("value") == 0, high).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), median / F.col("value"))))
    return rows.select("channel", "seq", F.round(scale, 9).alias("scale"))


#: Mean composition of an amino acid residue (C, H, N, O, S) and its mass: fixed values of the peptide model.
RESIDUE = {"C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417}
RESIDUE_MASS = 111.1254


def element_counts(masses: DataFrame) -> DataFrame:
    """Rounded numbers of atoms of each element for a neutral mass."""
    return masses.select("id", *[F.floor(F.lit(x) * F.col("mass") / RESIDUE_MASS + 0.5).cast("long").alias(f"n_{e.lower()}") for e, x in RESIDUE.items()])


def affinities(profiles: DataFrame) -> DataFrame:
    """Bhattacharyya coefficient and cosine of each profile and the next (absolute values, sums made 1)."""
    v = F.transform("profile", lambda x: F.abs(x.cast("double")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = profiles.select("id", v.alias("p"), (F.col("id") + 1).alias("next_id"))
    other = rows.select(F.col("id").alias("next_id"), F.col("p").alias("q"))
    both = rows.join(other, "next_id")
    share = total(F.zip_with("p", "q", lambda x, y: F.sqrt(x * y))) / F.sqrt(total(F.col("p")) * total(F.col("q")))
    dot = total(F.zip_with("p", "q", lambda x, y: x * y)) / F.sqrt(total(F.transform("p", lambda x: x * x)) * total(F.transform("q", lambda x: x * x)))
    return both.select("id", F.round(share, 6).alias("affinity"), F.round(dot, 6).alias("cosine"))


def reference_run(rows: DataFrame, floor: int) -> DataFrame:
    """The run with most rows from ``floor`` on; the last name wins ties."""
    return rows.groupBy("run").agg(F.count_if(F.col("value") >= floor).alias("n")).orderBy(F.desc("n"), F.desc("run")).limit(1)


def normalised_time(rows: DataFrame) -> DataFrame:
    """Position of each row in its run's extent, from 0 to 1; 0.5 where there is no extent."""
    extent = rows.groupBy("run").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    at = F.when(F.col("high") == F.col("low"), 0.5).otherwise((F.col("seq") - F.col("low")) / (F.col("high") - F.col("low")))
    return rows.join(F.broadcast(extent), "run").select("run", "seq", F.round(at, 9).alias("rt"))  # a row for each run


def clipped_line(rows: DataFrame, rounds: int = 5, sigmas: float = 3.0, least_sigma: float = 1e-9) -> DataFrame:
    """Least-squares line of value on x in each run, with rows beyond ``sigmas`` spreads left out for good.

    run, slope, intercept, n (rows left), cuts (the lines and distances that
    rows must keep).  A run is refitted after each of ``rounds`` cuts; it is
    done when its spread is below ``least_sigma``, and has all its rows back,
    under the line before, where fewer than two would be left.
    """
    none = F.array().cast("array<struct<slope:double,intercept:double,most:double>>")
    first = rows.groupBy("run").agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), F.count("*").alias("n"))
    state = cut_lineage(first.withColumns({"cuts": none, "done": F.lit(False)}))

    def again(state: DataFrame) -> DataFrame:
        """The line through the rows that keep all cuts, and their spread around it, in one pass: both from how they lie off the line before."""
        off = F.col("value") - F.col("slope") * F.col("x") - F.col("intercept")
        kept = kept_rows(rows, state).select("run", "x", off.alias("off"), "slope", "intercept")
        spread = F.sqrt(F.greatest(F.lit(0.0), F.regr_syy("off", "x") - F.regr_sxy("off", "x") * F.regr_slope("off", "x")) / (F.count("*") - 1))
        new = F.struct((F.first("slope") + F.regr_slope("off", "x")).alias("slope"), (F.first("intercept") + F.regr_intercept("off", "x")).alias("intercept"), F.count("*").alias("n"), F.when(F.count("*") > 1, spread).alias("sigma"))
        return state.join(F.broadcast(kept.groupBy("run").agg(new.alias("new"))), "run", "left")  # a row for each run

    state = cut_lineage(again(state).select(*state.columns, F.col("new.sigma").alias("sigma")))
    for _ in range(rounds):
        state = state.withColumn("done", F.col("done") | F.coalesce(F.col("sigma") < least_sigma, F.lit(True)))
        cut = F.struct("slope", "intercept", (sigmas * F.col("sigma")).alias("most"))
        state = again(state.withColumn("cuts", F.when(F.col("done"), F.col("cuts")).otherwise(F.concat("cuts", F.array(cut)))))
        few = ~F.col("done") & (F.coalesce("new.n", F.lit(0)) < 2)
        take = ~F.col("done") & ~few
        state = state.select(
            "run", *[F.when(take, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("slope", "intercept", "n", "sigma")],
            F.when(few, none).otherwise(F.col("cuts")).alias("cuts"), (F.col("done") | few).alias("done"),
        )
        state = cut_lineage(state)
    whole = rows.groupBy("run").agg(F.count("*").alias("whole"))
    return state.join(F.broadcast(whole), "run").select("run", "slope", "intercept", F.when(F.size("cuts") == 0, F.col("whole")).otherwise(F.col("n")).alias("n"), "cuts")


def kept_rows(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` that keep all cuts of their run's line, with that line's slope and intercept."""
    near = rows.join(F.broadcast(lines.select("run", "slope", "intercept", "cuts")), "run")  # a row for each run
    return near.where(F.forall("cuts", lambda c: F.abs(F.col("value") - c.slope * F.col("x") - c.intercept) <= c.most))


def spread_bins(rows: DataFrame, bins: int = 12, prior: float = 20.0, floor: float = 0.25) -> DataFrame:
    """run, bin, n, sigma: spread of ``residual`` in equal bins of ``x`` (0 to 1), shrunk to the run's; empty bins too.

    No rows where a run has fewer than two residuals or no spread.
    """
    whole = rows.groupBy("run").agg(F.var_samp("residual").alias("whole")).where(F.col("whole") > 0)
    at = F.least(F.lit(bins - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x"))) * bins)).cast("int")
    own = rows.groupBy("run", at.alias("bin")).agg(F.count("*").alias("n"), F.coalesce(F.var_samp("residual"), F.lit(0.0)).alias("own"))
    each = whole.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = each.join(own, ["run", "bin"], "left").withColumns({"n": F.coalesce("n", F.lit(0)).cast("long"), "own": F.coalesce("own", F.lit(0.0))})
    variance = (F.col("n") * F.col("own") + prior * F.col("whole")) / (F.col("n") + prior)
    return out.select("run", "bin", "n", F.greatest(F.sqrt(variance), floor * F.sqrt("whole")).alias("sigma"))


def _scan_sums(values: list[str]):
    def scan(batches):
        """Numbers sorted rows of a partition and sums their values, from the start of each key."""
        piece, last, nth, carried = TaskContext.get().partitionId(), None, 0, {v: 0 for v in values}
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("__key").to_numpy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
            goes_on = (group == 0) & (last is not None and key[0] == last)
            sums = []
            for v in values:
                x = batch.column(v).to_numpy().astype(np.int64)
                upto = np.cumsum(x)
                sums.append(upto - (upto - x)[starts[group]] + np.where(goes_on, carried[v], 0))
            last, carried = key[-1], {v: int(u[-1]) for v, u in zip(values, sums)}
            arrays = [*batch.columns, pa.array(np.full(len(key), piece, np.int32)), pa.array(np.arange(nth, nth + len(key))), *map(pa.array, sums)]
            nth += len(key)
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "__piece", "__nth", *[f"upto_{v}" for v in values]])

    return scan


def cumulated(rows: DataFrame, keys: list[str], order: list, values: list[str]) -> DataFrame:
    """``rows`` with ``upto_`` sums of whole numbers in the given order within each key, and __key, __piece, __nth (place in a piece).

    Rows are range-sorted, ties and all, so no key or value fills a task; what
    the pieces before hold comes by broadcast, a row for each piece and key in it.
    """
    key = F.xxhash64(*[F.col(k) for k in keys]) if keys else F.lit(0).cast("long")
    near = rows.withColumn("__key", key)
    order = [F.col("__key"), *order]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema.fields) + ", __piece int, __nth long, " + ", ".join(f"upto_{v} long" for v in values)
    out = cut_lineage(near.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan_sums(values), kinds))
    before = Window.partitionBy("__key").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    pieces = out.groupBy("__key", "__piece").agg(*[F.max(f"upto_{v}").alias(v) for v in values])
    pieces = pieces.select("__key", "__piece", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__{v}") for v in values])
    near = out.join(F.broadcast(pieces), ["__key", "__piece"])
    return near.select(*rows.columns, "__key", "__piece", "__nth", *[(F.col(f"upto_{v}") + F.col(f"__{v}")).alias(f"upto_{v}") for v in values])


def _least_behind(ranked: DataFrame, value: str) -> DataFrame:
    """``cumulated`` rows with ``least``, the least ``value`` of a row's own and all behind it in its key."""
    behind = Window.partitionBy("__key").orderBy(F.desc("__piece")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    ends = ranked.groupBy("__key", "__piece").agg(F.min(value).alias("own")).select("__key", "__piece", F.min("own").over(behind).alias("far"))
    inside = Window.partitionBy("__key", "__piece").orderBy(F.desc("__nth")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.join(F.broadcast(ends), ["__key", "__piece"]).withColumn("least", F.least(F.min(value).over(inside), F.col("far")))


def target_decoy_q(rows: DataFrame, conservative: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, id, score, decoy, q: decoys over targets at or above an entry in its key, then the least at or below; 1 at most.

    Entries of one score are ordered by id, as separate ranks; under
    ``conservative`` they share a block, and one decoy more is counted.  Decoys'
    q is 1.
    """
    keys = list(keys)
    rows = rows.select(*keys, "id", F.col("score").cast("double").alias("score"), "decoy")
    if conservative:
        counts = rows.groupBy(*keys, "score").agg(F.count_if(~F.col("decoy")).alias("t"), F.count_if("decoy").alias("d"))
        ranked = cumulated(counts, keys, [F.desc("score")], ["t", "d"])
        rate = F.when(F.col("t") > 0, F.least(F.lit(1.0), (F.col("upto_d") + 1) / F.greatest(F.lit(1), F.col("upto_t")))).otherwise(1.0)
        blocks = _least_behind(ranked.withColumn("rate", rate), "rate").select(*keys, "score", "least")
        on = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "score")]
        out = rows.alias("r").join(blocks.alias("b"), on).select(*[f"r.{c}" for c in rows.columns], F.col("b.least").alias("q"))
    else:
        marked = rows.withColumns({"t": (~F.col("decoy")).cast("int"), "d": F.col("decoy").cast("int")})
        ranked = cumulated(marked, keys, [F.desc("score"), F.col("id")], ["t", "d"])
        rate = F.when(~F.col("decoy"), F.least(F.lit(1.0), F.col("upto_d") / F.greatest(F.lit(1), F.col("upto_t")))).otherwise(1.0)
        out = _least_behind(ranked.withColumn("rate", rate), "rate").withColumn("q", F.col("least"))
    return out.select(*keys, "id", "score", "decoy", F.when(F.col("decoy"), 1.0).otherwise(F.coalesce("q", F.lit(1.0))).alias("q"))


def group_q(scores: DataFrame, nulls: DataFrame, cohorts: int) -> DataFrame:
    """score, n, q: (1 + null scores at or above / cohorts) / rank of each block of equal scores, made monotone; zero scores get 1."""
    of = lambda df, n, m: df.groupBy(F.col("score").cast("double").alias("score")).agg(n.alias("n"), m.alias("m"))
    zero = F.lit(0).cast("long")
    counts = of(scores, F.count("*"), F.max(zero)).union(of(nulls, F.max(zero), F.count("*"))).groupBy("score").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    ranked = cumulated(counts, [], [F.desc("score")], ["n", "m"])
    rate = F.when((F.col("n") > 0) & (F.col("score") > 0), F.least(F.lit(1.0), (1 + F.col("upto_m") / cohorts) / F.col("upto_n"))).otherwise(1.0)
    found = _least_behind(ranked.withColumn("rate", rate), "rate").where("n > 0")
    return found.select("score", "n", F.when(F.col("score") <= 0, 1.0).otherwise(F.col("least")).alias("q"))


def median_ratio(cells: DataFrame) -> DataFrame:
    """log2 factor of each run: median distance above the row means over rows that every run has, less the median run's."""
    n_runs = cells.select("run").distinct().agg(F.count("*").alias("n_runs"))
    full = cells.where("intensity > 0").withColumn("x", F.log2(F.col("intensity").cast("double")))
    rows = full.groupBy("row").agg(F.count("*").alias("n"), F.avg("x").alias("mean")).join(F.broadcast(n_runs), F.col("n") == F.col("n_runs")).select("row", "mean")
    factors = medians(full.join(rows, "row").select("run", (F.col("x") - F.col("mean")).alias("f")), ["run"], "f").select("run", F.col("median").alias("f"))
    every = cells.select("run").distinct().join(factors, "run", "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    return every.join(F.broadcast(every.agg(F.percentile("f", 0.5).alias("centre")))).select("run", (F.col("f") - F.col("centre")).alias("factor"))


def normalised(cells: DataFrame, factors: DataFrame) -> DataFrame:
    """``cells``, targets and decoys, with intensities divided by 2^factor of their run."""
    scaled = F.col("intensity") / F.pow(F.lit(2.0), F.coalesce("factor", F.lit(0.0)))
    return cells.join(F.broadcast(factors), "run", "left").withColumn("intensity", scaled).drop("factor")


def run_names(rows: DataFrame, most: int = 1000) -> list[str]:
    """The distinct runs, sorted; an error where there are more than ``most``, since each becomes a column."""
    found = sorted(r["run"] for r in rows.where("run is not null").select("run").distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} runs")
    return found


def matrix(cells: DataFrame, runs: list[str]) -> DataFrame:
    """A row for each row key, a column for each run; missing cells are 0."""
    return cells.groupBy("row").pivot("run", runs).agg(F.sum("intensity")).na.fill(0)


def dia_schedule(scans: DataFrame, least: int = 8, most_windows: int = 2000, ratio: float = 3.0) -> DataFrame:
    """Whether a run's fragment scans repeat a bounded set of windows."""
    found = scans.groupBy("run").agg(F.count("*").alias("n_scans"), F.count_distinct("window").alias("n_windows"))
    return found.withColumn("is_dia", (F.col("n_scans") >= least) & F.col("n_windows").between(1, most_windows) & (F.col("n_scans") / F.col("n_windows") >= ratio))


def donors(psms: DataFrame) -> DataFrame:
    """The best identification of each peptide and charge in each run: least q, then greatest score, then earliest."""
    best = Window.partitionBy("run", "peptide", "charge").orderBy("q", F.desc("score"), "seq")
    return psms.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def run_report(found: DataFrame) -> DataFrame:
    """Medians and spreads of the traces of each channel parity (two runs)."""
    rows = cut_lineage(found.select((F.col("channel") % 2).alias("run"), "n_scans", "intensity_max"))  # read three times
    whole = rows.groupBy("run").agg(F.count("*").alias("n"), F.round(F.stddev_samp("n_scans"), 6).alias("std_scans"))
    for name, value in (("median_scans", "n_scans"), ("median_apex", "intensity_max")):
        whole = whole.join(medians(rows, ["run"], value).select("run", F.col("median").alias(name)), "run", "left")
    return whole.select("run", "n", "median_scans", "median_apex", "std_scans")


def recalibration_surface(rows: DataFrame, mz_bins: int = 20, rt_bins: int = 8, least: int = 50, keys: tuple[str, ...] = ()) -> DataFrame:
    """Median and scaled MAD of ``residual`` in each (mz, rt) cell of ``least`` rows or more, each mz column and overall, within ``keys``.

    A column has rt_bin -1, the whole has -1 for both; extents stay in mz_low,
    mz_high, rt_low, rt_high.  No rows where there are fewer than ``least``.
    Medians go out again by broadcast: a row for each cell,
    ``mz_bins * (rt_bins + 1) + 1`` at most for each key.
    """
    keys = list(keys)
    beside = lambda left, right: left.join(F.broadcast(right), keys) if keys else left.join(F.broadcast(right))
    extent = rows.groupBy(*keys).agg(F.min("mz").alias("mz_low"), F.max("mz").alias("mz_high"), F.min("rt").alias("rt_low"), F.max("rt").alias("rt_high"), F.count("*").alias("whole")).where(F.col("whole") >= least)
    cells = beside(rows, extent).select(*keys, surface_bin("mz", mz_bins).alias("m"), surface_bin("rt", rt_bins).alias("r"), "residual")
    none = F.lit(-1)
    levels = F.array(F.struct(F.col("m").alias("mz_bin"), F.col("r").alias("rt_bin")), F.struct(F.col("m").alias("mz_bin"), none.alias("rt_bin")), F.struct(none.alias("mz_bin"), none.alias("rt_bin")))
    each = cells.select(*keys, F.col("residual").cast("double").alias("residual"), F.inline(levels))
    bins = [*keys, "mz_bin", "rt_bin"]
    centre = medians(each, bins, "residual").withColumnRenamed("median", "centre").where((F.col("rt_bin") < 0) | (F.col("n") >= least))
    off = each.join(F.broadcast(centre), bins).select(*bins, F.abs(F.col("residual") - F.col("centre")).alias("off"))
    spread = medians(off, bins, "off").select(*bins, F.when(F.col("n") < 2, 0.0).otherwise(1.4826 * F.col("median")).alias("spread"))
    return beside(centre.join(spread, bins), extent.drop("whole"))


def surface_bin(axis: str, n: int) -> F.Column:
    """Bin of a row on an axis whose extent is in ``<axis>_low`` and ``<axis>_high``; rows beyond go to the edge bins."""
    span = F.greatest(F.lit(1e-9), (F.col(f"{axis}_high") - F.col(f"{axis}_low")).cast("double")) * (1 + 1e-9)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(axis) - F.col(f"{axis}_low")) * n / span))).cast("int")


def medians(rows: DataFrame, keys: list[str], value: str, upper: bool = False) -> DataFrame:
    """keys, n, median (midpoint of the middle two, or the ``upper`` of them) of each group, however large.

    Values are counted and spread over hash-free ranges of their group, the
    ranges' counts tell which one holds the middle, and only its rows are ranked.
    """
    counts = rows.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    counts = cut_lineage(counts)
    cuts = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
    counts = counts.join(cuts, keys).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("v"))))
    sizes = counts.groupBy(*keys, "range", "n").agg(F.sum("c").alias("size"))
    upto = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # 64 rows a group
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    sizes = sizes.withColumn("end", F.sum("size").over(upto)).withColumn("begin", F.col("end") - F.col("size")).where((F.col("end") > low) & (F.col("begin") <= high))
    inside = Window.partitionBy(*keys, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    held = counts.select(*keys, "range", "v", "c").join(sizes.select(*keys, "range", "n", "begin"), [*keys, "range"]).withColumn("last", F.col("begin") + F.sum("c").over(inside))
    first, second = F.min(F.when(F.col("last") > low, F.col("v"))), F.min(F.when(F.col("last") > high, F.col("v")))
    return held.groupBy(*keys, "n").agg((second if upper else (first + second) / 2).alias("median"))


def noise_floor(found: DataFrame, share: float = 0.05, factor: float = 0.8) -> DataFrame:
    """``factor`` times the apex at the ``share`` of each run's sorted apexes; apexes are counted and cut into ranges before they are ranked."""
    counts = cut_lineage(found.groupBy("run", F.col("apex").cast("double").alias("apex")).agg(F.count("*").alias("n")))
    cuts = counts.groupBy("run").agg(F.floor(F.sum("n") * share).alias("at"), F.percentile_approx("apex", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
    counts = counts.join(F.broadcast(cuts), "run").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("apex"))))  # a row for each run
    upto = Window.partitionBy("run").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # 64 rows a run
    sizes = counts.groupBy("run", "range", "at").agg(F.sum("n").alias("size")).withColumn("end", F.sum("size").over(upto))
    sizes = sizes.where((F.col("end") > F.col("at")) & (F.col("end") - F.col("size") <= F.col("at"))).select("run", "range", (F.col("end") - F.col("size")).alias("begin"))
    inside = Window.partitionBy("run", "range").orderBy("apex").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(F.broadcast(sizes), ["run", "range"]).withColumn("upto", F.col("begin") + F.sum("n").over(inside))
    return ranked.where(F.col("upto") > F.col("at")).groupBy("run").agg(F.round(F.min("apex") * factor, 3).alias("floor"))


def cells(groups: DataFrame, runs: list[str], shift: float = 11.0, rt_share: float = 0.01) -> DataFrame:
    """A target and a decoy cell of each group in each run; decoys lie ``shift`` Da and a share of the time span away."""
    span = groups.agg((F.max("rt") - F.min("rt")).alias("span"))
    decoy = F.explode(F.array(F.lit(False), F.lit(True)))
    each = groups.join(F.broadcast(span)).withColumn("run", F.explode(F.array(*map(F.lit, runs)))).withColumn("decoy", decoy)
    off = F.col("decoy").cast("int")
    return each.select("id", "run", "decoy", F.round(F.col("mz") + off * shift / F.col("charge"), 6).alias("mz"), F.round(F.col("rt") - off * rt_share * F.col("span"), 6).alias("rt"))
