"""Queries of the tracking, isotope and alignment operators over the given tables, and the same in DuckDB's SQL.

Spectra are a ladder: order lines as peaks, suppliers modulo four as channels,
weeks as scans, quantities as rungs half a neutron apart from 500 on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.functions.lineage import cut_lineage
from lumentrace.operators import alignment, chains, consensus, guided, isotopes, ownership, quantification, rescoring, targets, tracking
from lumentrace.sources.adapters import table

PPM, MAX_GAP, MIN_SCANS, CHARGE = 10.0, 1, 3, 2
SULFUR = [-1, 0, 1]


def spectra(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.lit("r").alias("run"), (F.col("l_suppkey") % 4).cast("double").alias("channel"), F.expr("cast(unix_date(cast(l_shipdate as date)) div 7 as int)").alias("scan"),
        F.expr("cast(l_quantity as bigint)").alias("rung"), F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("cents"),
    )
    rows = rows.groupBy("run", "channel", "scan", "rung").agg(F.sum("cents").cast("double").alias("intensity"))
    return rows.select("run", "channel", "scan", F.col("scan").cast("double").alias("rt"), (500 + F.col("rung") * F.lit(isotopes.NEUTRON / CHARGE)).alias("mz"), "intensity", F.lit(0.0).alias("im"))


def hills(spark, d):
    return tracking.track(spectra(spark, d), tracking.Tracking(ppm=PPM, max_gap=MAX_GAP, min_scans=MIN_SCANS))


def _tracked(spark, d):
    names = ["scan_start", "scan_apex", "scan_end", "n_scans", "skipped_scans"]
    return hills(spark, d).select("channel", F.round("mz", 6).alias("mz"), *names, "intensity_sum", "intensity_max", F.round("hill_score", 9).alias("hill_score"))


def _neighbours(spark, d):
    found = tracking.numbered(hills(spark, d))
    asked = found.select(
        "run", "channel", F.col("scan_start").alias("start"), F.col("mz").alias("from_mz"), (F.col("mz") + F.lit(isotopes.NEUTRON / CHARGE)).alias("target"), (F.col("mz") * PPM * 1e-6).alias("tolerance"), F.col("scan_start").alias("ref_start"),
        F.col("scan_end").alias("ref_end"), F.col("im").alias("ref_im"), F.col("intensity_max").alias("ref_intensity"), F.array("hill_id").alias("taken"),
    )
    near = chains.neighbours(asked, found, PPM, min_ratio=0.5)
    return near.select("channel", F.round("from_mz", 6).alias("from_mz"), "start", F.round("hill.mz", 6).alias("to_mz"), F.col("hill.scan_start").alias("to_start"))


def _features(spark, d):
    found = cut_lineage(tracking.numbered(hills(spark, d)))
    chosen = chains.resolved(chains.with_evidence(chains.candidates(found, chains.Chains(charges=(CHARGE, CHARGE)))))
    scored = isotopes.score_features(chains.features(chosen, found), SULFUR)
    return scored.select("run", "channel", "charge", "mz", "mass", "n_isotopes", "cosine_score", "ppm_error", "isotope_score", "combined_score", "hill_ids")


def _masses(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("mass"))


def _patterns(spark, d):
    rows = isotopes.with_patterns(_masses(spark, d), "mass")
    return rows.select("id", *[F.round(F.get("pattern", F.lit(k)), 9).alias(f"p{k}") for k in range(5)])


def _best_sulfur(spark, d):
    rows = isotopes.with_patterns(_masses(spark, d), "mass", SULFUR)
    observed = F.array(F.lit(5.0), (F.col("id") % 7 + 1).cast("double"), (F.col("id") % 3).cast("double"))
    best = rows.select("id", isotopes.best_affinity(observed, F.col("templates")).alias("b"))
    return best.select("id", F.round("b.score", 9).alias("score"), F.col("b.sulfur").alias("sulfur"))


#: Middle and half width of the extraction window, in weeks; half weeks keep scans off the columns' borders.
MIDDLE, HALF, RUNGS = 1300.5, 50.0, [10, 20, 30]


def _grid(spark, d):
    found = hills(spark, d).withColumn("run", F.col("channel").cast("string"))
    each = found.select("run").distinct().withColumn("cell_id", F.explode(F.array(*map(F.lit, RUNGS))))
    mz = 500 + F.col("cell_id") * F.lit(isotopes.NEUTRON / CHARGE)
    cells = each.select("cell_id", "run", F.lit(False).alias("decoy"), mz.alias("mz"), F.lit(CHARGE).alias("charge"), F.lit(MIDDLE).alias("rt"), F.lit(0.0).alias("im"))
    rows = quantification.grids(cells, found, quantification.Extraction(ppm=PPM, half_window=HALF))
    return rows.select("run", "cell_id", "iso", F.round("winner_mz", 6).alias("winner_mz"), F.posexplode("grid").alias("col", "v")).where("v > 0")


#: Isotope shares and middles of the windows that cells of every rung are measured in.
TEMPLATE, MIDDLES = [0.55, 0.3, 0.15], [1200.5, 1300.5, 1400.5]
EXTRACTION = quantification.Extraction(ppm=PPM, half_window=HALF)


def _measured_cells(found):
    """A target cell of every rung and window in each run (channel)."""
    each = found.select("run").distinct().withColumn("rung", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("rt", F.explode(F.array(*map(F.lit, MIDDLES))))
    group = (F.col("rung") * 10000 + F.floor("rt")).cast("long")
    mz = 500 + F.col("rung") * F.lit(isotopes.NEUTRON / CHARGE)
    return each.select(group.alias("cell_id"), group.alias("group"), "run", F.lit(False).alias("decoy"), mz.alias("mz"), F.lit(CHARGE).alias("charge"), "rt", F.lit(0.0).alias("im"), F.array(*map(F.lit, TEMPLATE)).alias("template"))


def _quantify(spark, d, method):
    found = cut_lineage(tracking.numbered(hills(spark, d)).withColumn("run", F.col("channel").cast("string")))
    rows = method(_measured_cells(found), found, EXTRACTION)
    values = ["hybrid", "pattern", "coelution", "preceding", "observed_mz"]
    more = [c for c in ("owned_samples", "excluded_samples", "ownership", "competitor") if c in rows.columns]
    return rows.select("run", "group", "intensity", "apex", "start", "end", "n_found", *[F.round(c, 6).alias(c) for c in values], *more)


def _scored_cells(spark, d):
    """Events as cells: users are groups and peptides, odd events decoys, and a target's values lie apart from a decoy's the more the greater they are."""
    tenth = lambda k: (F.pmod(F.xxhash64("event_id", F.lit(k)), F.lit(1000)) / 1000).cast("double")
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("group"), (F.col("event_id") % 2 == 1).alias("decoy"), F.when(F.col("event_id") % 19 > 0, F.col("value")).otherwise(0.0).alias("intensity"),
        F.concat(F.lit("P"), F.col("user_id")).alias("peptide"), (F.col("user_id") % 4 + 1).cast("int").alias("charge"), (F.col("value") / (1 + F.col("value"))).alias("weight"), *[tenth(k).alias(f"x{k}") for k in range(6)],
    )
    lift = F.when(F.col("decoy"), 0.0).otherwise(F.col("weight"))
    values = {"hybrid": F.col("x0") + 0.5 * lift, "ppm": F.col("x1") - 0.5 * lift, "rt_off": F.col("x2") - lift, "pattern": F.col("x3") + lift, "coelution": F.when(F.col("x4") > 0.05, F.col("x4") + lift), "im_off": F.lit(None).cast("double")}
    return rows.withColumns(values)


def _run_features(spark, d):
    """Parts as the features of run a; every third of them a little heavier and later as those of run b."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").cast("double").alias("mz"), (F.col("p_size") % 3 + 1).cast("int").alias("charge"), F.col("p_size").cast("double").alias("rt"))
    rows = part.withColumns({"run": F.lit("a"), "im": F.lit(0.0), "score": F.lit(0.9)})
    second = rows.where("feature_id % 3 = 0").withColumns({"run": F.lit("b"), "mz": F.col("mz") + F.lit(0.001), "rt": F.col("rt") + 1})
    return rows.unionByName(second)


def _candidates(spark, d):
    pairs = alignment.anchor_candidates(_run_features(spark, d), "a", alignment.Warping(anchor_ppm=5.0, rt_window=0.05))
    return pairs.select("run", "charge", "ref_id", "run_id", F.round("ref_rt", 9).alias("ref_rt"), F.round("run_rt", 9).alias("run_rt"))


def _groups(spark, d):
    rows = consensus.projected(_run_features(spark, d).withColumns({"ref_mz": F.col("mz"), "ref_rt": F.col("rt")}))
    return consensus.groups(consensus.clusters(rows)).select("charge", "group_id", "mass", "rt", "n_members", "n_runs", F.round("group_score", 9).alias("group_score"))


def _identifications(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("run"), (F.col("user_id") % 40).cast("string").alias("peptide"), (F.col("event_id") % 2 + 2).cast("int").alias("charge"), (F.lit(900.0) + F.col("user_id") % 40).alias("mass"),
        F.col("event_id").cast("double").alias("rt"), (F.col("value") % 1).alias("q"), F.lit(None).cast("double").alias("im"), F.col("event_id").alias("row"),
    )


def _targets(spark, d):
    found = targets.build(_identifications(spark, d), rt_span=1e9)
    return found.select("peptide", "charge", "mass", F.round("mz", 6).alias("mz"), "n_runs", F.col("seed.row").alias("seed_row"), "reason")


def _search_quant(spark, d):
    """Each peptide's charges in every run: evidence and status of cells whose signal is the number of every third event."""
    ids = _identifications(spark, d)
    observed = ids.groupBy("run").agg(*[f(F.col("mass") / F.col("charge") + isotopes.PROTON).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))])
    aligned = targets.eligible_runs(table(spark, d, "events").select(F.col("event_type").alias("run"), (F.col("user_id") % 7 == 0).alias("active")), 2).where("run <> 'click'")
    measured = ids.where("row % 3 = 0").groupBy("peptide", "charge", "run").agg(F.count("*").cast("double").alias("intensity"), F.min("q").alias("q"))
    planned = guided.plan(targets.expanded(targets.build(ids, rt_span=1e9), observed, (1, 4)), ids, observed, aligned)
    return guided.labelled(planned, measured, 0.3, True)


QUERIES = {
    "hil_track_ppm": _tracked,
    "lfq_grid": _grid,
    "lfq_quantify": lambda s, d: _quantify(s, d, quantification.quantified),
    "lfq_ownership": lambda s, d: _quantify(s, d, ownership.two_passes),
    "lfq_rescored": lambda s, d: rescoring.rescored(_scored_cells(s, d)).withColumns({c: F.round(c, 6) for c in ("score", "q")}),
    "lfq_search_rescored": lambda s, d: rescoring.search_rescored(_scored_cells(s, d)).withColumns({c: F.round(c, 6) for c in ("score", "q")}),
    "aln_anchor_candidates": _candidates,
    "aln_anchors": lambda s, d: alignment.anchors(alignment.anchor_candidates(_run_features(s, d), "a", alignment.Warping(anchor_ppm=5.0, rt_window=0.05))).select("run", "charge", "ref_id", "run_id"),
    "con_groups": _groups,
    "tgt_targets": _targets,
    "tgt_search_quant": _search_quant,
    "fea_ppm_neighbours": _neighbours,
    "fea_isotope_features": _features,
    "sco_isotope_pattern": _patterns,
    "sco_best_sulfur": _best_sulfur,
    "pre_noise_clip": lambda s, d: tracking.clip_noise(spectra(s, d), 1.0).select("channel", "scan", F.round("mz", 6).alias("mz"), "intensity"),
    "pre_decoy_scans": lambda s, d: tracking.shuffled_scans(spectra(s, d).withColumn("old", F.col("scan"))).groupBy("channel", "old", F.col("scan").alias("new")).agg(F.count("*").alias("n"), F.sum("intensity").alias("intensity")),
}

_RUNGS = f"""
rungs as (
  select (l_suppkey % 4)::double as channel, ((l_shipdate::date - date '1970-01-01') // 7)::int as scan, 500 + l_quantity::bigint * {isotopes.NEUTRON / CHARGE!r}::double as mz, sum(round(l_extendedprice * 100)::bigint)::double as v
  from lineitem group by all
)"""
_HILLS = f"""with {_RUNGS}, opened as (select *, case when scan - lag(scan) over w <= {MAX_GAP + 1} then 0 else 1 end as opens from rungs window w as (partition by channel, mz order by scan)),
numbered as (select *, sum(opens) over (partition by channel, mz order by scan rows unbounded preceding) as k from opened),
hills as (select channel, mz, k, min(scan) as scan_start, max(scan) as scan_end, arg_max(scan, (v, scan)) as scan_apex, (max(scan) - min(scan) + 1)::int as n_scans, (max(scan) - min(scan) + 1 - count(*))::int as skipped_scans,
  sum(v) as intensity_sum, max(v) as intensity_max from numbered group by all having count(*) >= {MIN_SCANS})"""
_TABLES = (
    "recursive single as (select * from (values "
    + ", ".join(f"('{e}', {(one + [0.0] * isotopes.SLOTS)[: isotopes.SLOTS]}::double[], {most})" for e, (one, most) in isotopes.ISOTOPES.items())
    + f") v(e, s, most)), t as (select e, 0 as n, {[1.0] + [0.0] * (isotopes.SLOTS - 1)}::double[] as p, s, most from single union all select e, n + 1, "
    + "list_transform(range(1, 11), lambda k: list_sum(list_transform(range(1, k + 1), lambda i: p[i] * s[k - i + 1]))), s, most from t where n < most)"
)


def _product(a: str, b: str) -> str:
    return f"list_transform(range(1, 11), lambda k: list_sum(list_transform(range(1, k + 1), lambda i: {a}[i] * {b}[k - i + 1])))"


_ATOMS = ", ".join(f"floor({x}::double * mass / {isotopes.RESIDUE_MASS}::double + 0.5)::int as n_{e.lower()}" for e, x in isotopes.RESIDUE.items())
_BASE = f"""with {_TABLES}, m as (select p_partkey as id, p_retailprice::double as mass from part), n as (select *, {_ATOMS}, ceil({isotopes.RESIDUE["S"]}::double * mass / {isotopes.RESIDUE_MASS}::double)::int as up from m),
b0 as (select n.*, c.p as c, h.p as h, nn.p as nn, o.p as o from n join t c on c.e = 'c' and c.n = n_c join t h on h.e = 'h' and h.n = n_h join t nn on nn.e = 'n' and nn.n = n_n join t o on o.e = 'o' and o.n = n_o),
b1 as (select *, {_product("c", "h")} as ch from b0), b2 as (select *, {_product("ch", "nn")} as chn from b1), b3 as (select *, {_product("chn", "o")} as base from b2)"""

ORACLE_SQL = {
    "hil_track_ppm": _HILLS + """, z as (
  select h.channel, h.mz, h.k, h.scan_apex, s.scan, coalesce(n.v, 0) as v from hills h, lateral (select unnest(range(h.scan_start, h.scan_end + 1)) as scan) s left join numbered n on n.channel = h.channel and n.mz = h.mz and n.k = h.k and n.scan = s.scan
), g as (select *, lag(v) over (partition by channel, mz, k order by scan) as b from z), sc as (select channel, mz, k, avg(case when scan <= scan_apex then (v >= b)::int else (v <= b)::int end) filter (b is not null) as s from g group by all)
select channel, round(mz, 6) as mz, scan_start, scan_apex, scan_end, n_scans, skipped_scans, intensity_sum, intensity_max, round(s, 9) as hill_score from hills join sc using (channel, mz, k)""",
    "lfq_grid": _HILLS + f""", cells as (select distinct channel, q as cell_id, i as iso, 500 + q * {isotopes.NEUTRON / CHARGE!r}::double + i * {isotopes.NEUTRON!r}::double / {CHARGE} as target from hills, unnest({RUNGS}) a(q), unnest([0, 1, 2]) b(i)),
near as (select c.channel, c.cell_id, c.iso, h.mz, h.k, h.intensity_sum from cells c join hills h on h.channel = c.channel and abs(h.mz - c.target) <= c.target * 10e-6::double and h.scan_end >= {MIDDLE - HALF} and h.scan_start <= {MIDDLE + HALF}),
s as (select near.*, floor((n.scan - {MIDDLE - HALF}::double) / {2 * HALF} * 25)::int as col, n.v from near join numbered n using (channel, mz, k) where n.scan >= {MIDDLE - HALF} and n.scan < {MIDDLE + HALF}),
w as (select channel, cell_id, iso, arg_max(mz, (intensity_sum, -mz)) as winner_mz from s group by all)
select channel::varchar as run, cell_id, iso, round(winner_mz, 6) as winner_mz, col, sum(v) as v from s join w using (channel, cell_id, iso) group by all""",
    "lfq_quantify": _HILLS + f""", cells as (select distinct channel, q * 10000 + floor(m)::bigint as grp, m::double as rt, i as iso, 500 + q * {isotopes.NEUTRON / CHARGE!r}::double + i * {isotopes.NEUTRON!r}::double / {CHARGE} as target
  from hills, range(1, 51) a(q), unnest({MIDDLES}) b(m), unnest([-1, 0, 1, 2]) c(i)),
near as (select c.*, h.mz, h.k, h.intensity_sum from cells c join hills h on h.channel = c.channel and abs(h.mz - c.target) <= c.target * 10e-6::double and h.scan_end >= c.rt - {HALF} and h.scan_start <= c.rt + {HALF}),
s as (select near.*, floor((n.scan - (rt - {HALF}::double)) / {2 * HALF} * 25)::int as col, n.v from near join numbered n using (channel, mz, k) where n.scan >= rt - {HALF} and n.scan < rt + {HALF}),
t as (select distinct channel, grp, c::int as col from cells, range(25) r(c)),
g as (select channel, grp, col, coalesce(sum(v) filter (iso = -1), 0) as p, coalesce(sum(v) filter (iso = 0), 0) as a, coalesce(sum(v) filter (iso = 1), 0) as b, coalesce(sum(v) filter (iso = 2), 0) as c from t left join s using (channel, grp, col) group by all),
w as (select channel, grp, max(a + b + c) as top, arg_max(col, (a + b + c, col)) as apex, (max(a) > 0)::int + (max(b) > 0)::int + (max(c) > 0)::int as n_found, max(b) > 0 as has_b, max(c) > 0 as has_c,
  coalesce(sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 0) as ab, coalesce(sum(a * c) / nullif(sqrt(sum(a * a)) * sqrt(sum(c * c)), 0), 0) as ac, coalesce(sum(a * p) / nullif(sqrt(sum(a * a)) * sqrt(sum(p * p)), 0), 0) as ap from g group by all),
x as (select *, case when has_b or has_c then (case when has_b then {TEMPLATE[1]}::double * ab else 0 end + case when has_c then {TEMPLATE[2]}::double * ac else 0 end) / (case when has_b then {TEMPLATE[1]}::double else 0 end + case when has_c then {TEMPLATE[2]}::double else 0 end) else 0.5 end as coelution from w),
y as (select *, case when a + b + c > 0 then (sqrt(a * {TEMPLATE[0]}::double) + sqrt(b * {TEMPLATE[1]}::double) + sqrt(c * {TEMPLATE[2]}::double)) / sqrt(a + b + c) else 0 end as pattern from g join x using (channel, grp) where top > 0),
h as (select *, greatest(0, (1 - cbrt(abs(col - 12) / 12.0::double)) * sqrt((a + b + c) / top) * pattern * coelution) ^ 0.25 as hybrid from y),
e as (select *, max(hybrid) filter (col = apex) over (partition by channel, grp) as best from h),
u as (select channel, grp, apex, greatest(0, apex - 7, coalesce(max(col) filter (col < apex and (pattern < 0.5 or hybrid < best / 2)), -1) + 1) as start, least(24, apex + 7, coalesce(min(col) filter (col > apex and (pattern < 0.5 or hybrid < best / 2)), 25) - 1) as end_ from e group by channel, grp, apex),
o as (select channel, grp, arg_max(mz, (intensity_sum, -mz)) as observed_mz from s where iso = 0 group by all),
z as (select e.channel, e.grp, e.apex, u.start, u.end_, n_found, sum(a + b + c) as intensity, max(hybrid) filter (col = e.apex) as hybrid, max(pattern) filter (col = e.apex) as pattern, coelution, ap * sum(p) / greatest(sum(p) + sum(a + b + c), 1e-300::double) as preceding
  from e join u using (channel, grp) where (col between u.start and u.end_) group by e.channel, e.grp, e.apex, u.start, u.end_, n_found, coelution, ap)
select t.channel::varchar as run, t.grp as "group", coalesce(intensity, 0) as intensity, coalesce(apex, -1) as apex, coalesce(start, -1) as start, coalesce(end_, -1) as "end", coalesce(n_found, 0) as n_found, round(coalesce(hybrid, 0), 6) as hybrid, round(coalesce(pattern, 0), 6) as pattern,
  round(coalesce(coelution, 0), 6) as coelution, round(coalesce(preceding, 0), 6) as preceding, round(observed_mz, 6) as observed_mz from (select distinct channel, grp from t) t left join z using (channel, grp) left join o using (channel, grp)""",
    "aln_anchor_candidates": """with a as (select p_partkey as id, p_retailprice::double as mz, (p_size % 3 + 1)::int as charge, p_size::double as rt from part), b as (select id, mz + 0.001::double as mz, charge, rt + 1 as rt from a where id % 3 = 0),
x as (select *, (rt - min(rt) over ()) / (max(rt) over () - min(rt) over ()) as x from a), y as (select *, (rt - min(rt) over ()) / (max(rt) over () - min(rt) over ()) as x from b)
select 'b' as run, x.charge, x.id as ref_id, y.id as run_id, round(x.x, 9) as ref_rt, round(y.x, 9) as run_rt from x join y on x.charge = y.charge and abs(y.mz - x.mz) <= x.mz * 5e-6::double and abs(x.x - y.x) <= 0.05::double""",
    "aln_anchors": """with recursive a as (select p_partkey as id, p_retailprice::double as mz, (p_size % 3 + 1)::int as charge, p_size::double as rt from part), b as (select id, mz + 0.001::double as mz, charge, rt + 1 as rt from a where id % 3 = 0),
x as (select *, (rt - min(rt) over ()) / (max(rt) over () - min(rt) over ()) as x from a), y as (select *, (rt - min(rt) over ()) / (max(rt) over () - min(rt) over ()) as x from b),
c as (select x.charge, x.id as ref_id, x.mz, y.id as run_id, abs(y.mz - x.mz) / x.mz * 1e6 as ppm, y.mz as run_mz from x join y on x.charge = y.charge and abs(y.mz - x.mz) <= x.mz * 5e-6::double and abs(x.x - y.x) <= 0.05::double),
l as (select charge, ref_id, mz, list(run_id order by ppm, run_mz, run_id) as tries from c group by all),
n as (select *, row_number() over (partition by charge order by mz, ref_id) as i from l),
t as (select charge, ref_id, tries, i, tries[1] as pick, [tries[1]] as used from n where i = 1
  union all select charge, ref_id, tries, i, pick, case when pick is null then used else list_append(used, pick) end
  from (select n.charge, n.ref_id, n.tries, n.i, list_filter(n.tries, lambda z: not list_contains(t.used, z))[1] as pick, t.used from t join n on n.charge = t.charge and n.i = t.i + 1))
select 'b' as run, charge, ref_id, pick as run_id from t where pick is not null""",
    "con_groups": f"""with recursive a as (select 'a' as run, p_partkey as id, p_retailprice::double as mz, (p_size % 3 + 1)::int as charge, p_size::double as rt from part),
u as (select * from a union all select 'b', id, mz + 0.001::double, charge, rt + 1 from a where id % 3 = 0), m as (select *, mz * charge - charge * {isotopes.PROTON!r}::double as mass from u),
r as (select *, row_number() over (partition by charge order by mass, rt, run, id) as i from m where mass > 0),
t as (select charge, i, i as g, [{{'s': i, 'sm': mass, 'sr': rt, 'low': mass, 'rl': rt, 'rh': rt}}] as held from r where i = 1
  union all select charge, i, coalesce(pick.s, i), case when pick is null then list_append(near, {{'s': i, 'sm': mass, 'sr': rt, 'low': mass, 'rl': rt, 'rh': rt}})
    else list_transform(near, lambda z: case when z.s = pick.s then {{'s': z.s, 'sm': z.sm, 'sr': z.sr, 'low': z.low, 'rl': least(z.rl, rt), 'rh': greatest(z.rh, rt)}} else z end) end
  from (select *, list_sort(list_transform(list_filter(near, lambda z: greatest(z.rh, rt) - least(z.rl, rt) <= 1.0), lambda z: {{'far': ((mass - z.sm) / z.sm * 1e6 / 10.0::double) ** 2 + (rt - z.sr) ** 2, 's': z.s}}))[1] as pick
    from (select r.charge, r.i, r.mass, r.rt, list_filter(t.held, lambda z: (r.mass - z.low) / z.low * 1e6 <= 10.0) as near from t join r on r.charge = t.charge and r.i = t.i + 1))),
k as (select r.*, t.g from r join t using (charge, i)),
p as (select charge, g, run, count(*) as n, min(i) as i from k group by all),
q as (select p.*, r.mass, r.rt, 0.9::double * 0.9::double / (0.9::double * n) as quality from p join r using (charge, i)),
s as (select x.charge, x.g, sqrt(x.quality * y.quality) * exp(-2 * (((x.mass - y.mass) / least(x.mass, y.mass) * 1e6 / 10.0::double) ** 2 + (x.rt - y.rt) ** 2)) as score from q x join q y on x.charge = y.charge and x.g = y.g and x.run = 'a' and y.run = 'b')
select charge, r.run || ':' || r.id as group_id, r.mass, r.rt, w.n_members, w.n_runs, round(coalesce(s.score, 0), 9) as group_score
from (select charge, g, sum(n)::bigint as n_members, count(*) as n_runs from q group by all) w join (select charge, i as g, run, id, mass, rt from r) r using (charge, g) left join s using (charge, g)""",
    "pre_noise_clip": f"""with recursive {_RUNGS}, c as (select channel, scan, list(v order by v) as held from rungs group by all having count(*) >= 3),
t as (select channel, scan, held, list_median(held) as m, false as done from c
  union all select channel, scan, kept, list_median(kept), len(kept) = len(held) or len(kept) < 3
  from (select *, list_filter(held, lambda x: x <= m + 1.4826::double * list_median(list_transform(held, lambda y: abs(y - m)))) as kept from t where not done)),
f as (select channel, scan, m + 1.4826::double * list_median(list_transform(held, lambda y: abs(y - m))) as floor from t where done and len(held) > 0)
select channel, scan, round(mz, 6) as mz, v as intensity from rungs left join f using (channel, scan) where floor is null or v > floor""",
    "tgt_search_quant": f"""with i as (select event_type as run, (user_id % 40)::varchar as peptide, (event_id % 2 + 2)::int as charge, 900.0::double + user_id % 40 as mass, event_id::double as rt, value::double % 1 as q, event_id as row from events),
d as (select * from i qualify row_number() over (partition by run, peptide, charge order by q, rt, mass, row) = 1),
n as (select * from d qualify row_number() over (partition by run, peptide order by q, charge, row) = 1),
s as (select * from d qualify row_number() over (partition by peptide, charge order by q, rt, mass, run, row) = 1),
b as (select * from s qualify row_number() over (partition by peptide order by q, charge) = 1),
o as (select run, min(mass / charge + {isotopes.PROTON!r}::double) as low, max(mass / charge + {isotopes.PROTON!r}::double) as high from i group by run),
t as (select peptide, charge, false as inferred, run as seed_run, q as seed_q, row as seed_row, mass from s
  union all select b.peptide, z::int, true, b.run, b.q, b.row, b.mass from b, range(1, 5) x(z) where not exists (select 1 from s where s.peptide = b.peptide and s.charge = z) and exists (select 1 from o where b.mass / z + {isotopes.PROTON!r}::double between o.low and o.high)),
g as (select event_type as run from events where user_id % 7 = 0 and event_type <> 'click' group by 1 having count(*) >= 2),
m as (select peptide, charge, run, count(*)::double as intensity, min(q) as q from i where row % 3 = 0 group by all),
p as (select t.peptide, t.charge, o.run, seed_run, seed_q, seed_row, d.q as direct_q, d.row as direct_row, coalesce(m.intensity, 0) as intensity, m.q,
  case when d.row is not null then 'direct_ms2' when inferred and n.row is not null then 'inferred_charge' when inferred then 'mbr_inferred_charge' else 'mbr' end as evidence,
  d.row is not null or (inferred and n.row is not null) or (g.run is not null and (not inferred or t.mass / t.charge + {isotopes.PROTON!r}::double between o.low and o.high)) as attempted
  from t cross join o left join d on d.peptide = t.peptide and d.charge = t.charge and d.run = o.run left join n on n.peptide = t.peptide and n.run = o.run left join g on g.run = o.run left join m on m.peptide = t.peptide and m.charge = t.charge and m.run = o.run),
l as (select *, case when not attempted then 'not_attempted' when intensity <= 0 then 'no_signal' when evidence = 'direct_ms2' or q <= 0.3 then 'accepted' else 'rejected' end as status from p)
select peptide, charge, run, evidence, status, intensity, case when status = 'accepted' then intensity else 0.0 end as accepted_intensity, case when attempted then q end as extraction_q, direct_q, seed_run, seed_q, direct_row, seed_row from l""",
    "tgt_targets": f"""with i as (select event_type as run, (user_id % 40)::varchar as peptide, (event_id % 2 + 2)::int as charge, 900.0::double + user_id % 40 as mass, event_id::double as rt, value::double % 1 as q, event_id as row from events),
d as (select *, row_number() over (partition by run, peptide, charge order by q, rt, mass, row) as nth from i)
select peptide, charge, min(mass) as mass, round(min(mass) / charge + {isotopes.PROTON!r}::double, 6) as mz, count(*) as n_runs, arg_min(row, (q, rt)) as seed_row, null::varchar as reason from d where nth = 1 group by peptide, charge""",
    "fea_ppm_neighbours": _HILLS + f""" select a.channel, round(a.mz, 6) as from_mz, a.scan_start as start, round(b.mz, 6) as to_mz, b.scan_start as to_start from hills a join hills b on a.channel = b.channel
  and abs(b.mz - (a.mz + {isotopes.NEUTRON / CHARGE!r}::double)) <= a.mz * 10e-6::double and least(a.scan_end, b.scan_end) >= greatest(a.scan_start, b.scan_start) and b.intensity_max >= 0.5 * a.intensity_max""",
    "sco_isotope_pattern": _BASE + f", w as (select id, {_product('base', 's.p')} as p from b3 join t s on s.e = 's' and s.n = n_s) select id, " + ", ".join(f"round(p[{k + 1}] / list_sum(p), 9) as p{k}" for k in range(5)) + " from w",
    "sco_best_sulfur": _BASE + f""", tried as (select distinct id, base, greatest(0, up + o.o) as sulfur from b3, unnest({SULFUR}) o(o)),
w as (select id, sulfur, {_product("base", "s.p")} as p from tried join t s on s.e = 's' and s.n = sulfur), u as (select id, sulfur, list_transform(p, lambda x: x / list_sum(p)) as p from w),
q as (select id, sulfur, p[1] + p[2] + p[3] as q, 5.0::double + (id % 7 + 1) + id % 3 as total, sqrt(5.0 * p[1]) + sqrt((id % 7 + 1) * p[2]) + sqrt((id % 3) * p[3]) as dot from u),
x as (select id, sulfur, dot / sqrt(total * q) * q as score from q)
select id, round(score, 9) as score, sulfur from x qualify row_number() over (partition by id order by score desc, sulfur) = 1""",
    "pre_decoy_scans": f"""with {_RUNGS}, c as (select channel, scan, count(*) as n, sum(v) as intensity from rungs group by all),
o as (select *, row_number() over (partition by channel order by scan) as nth, row_number() over (partition by channel order by md5(scan::varchar || ':0'), scan) as drawn from c)
select a.channel, a.scan as old, b.scan as new, a.n, a.intensity from o a join o b on a.channel = b.channel and a.nth = b.drawn""",
}
