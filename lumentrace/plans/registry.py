"""The registered queries: callables on (spark, sf_dir), and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.operators import statistics as st
from lumentrace.operators import traces as tr
from lumentrace.plans import signal
from lumentrace.sources.adapters import PEAKS_SQL, SERIES_SQL, peaks, series, table

FLAGSHIP = "hil_traces"
TOLERANCE = 0.0005
#: Rows that cells and runs are made of.
WITH_TRACES = f"with {PEAKS_SQL},{tr.TRACES_SQL}\n"
#: Every scan of every trace, 0 in gaps.
ZEROS = WITH_TRACES + """, z as (
  select t.channel, t.trace, t.scan_start, t.scan_end, s.scan, coalesce(m.intensity, 0)::double as v
  from traces t, lateral (select unnest(range(t.scan_start, t.scan_end + 1)) as scan) s left join members m on m.channel = t.channel and m.trace = t.trace and m.scan = s.scan
)"""


def _scores(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(F.col("n_chars").alias("score"), (F.col("toxic") == 1).alias("decoy"))


def _cells(spark, d):
    return series(spark, d).groupBy(F.col("channel").alias("row"), "run").agg(F.sum("value").alias("intensity"))


def _masses(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("mass"))


def _residuals(spark, d):
    cents = F.expr("cast(round(l_extendedprice * 100) as bigint)")
    return table(spark, d, "lineitem").select(F.expr("cast(l_quantity as bigint)").alias("mz"), F.col("l_suppkey").alias("rt"), (cents % 1000 - 500).alias("residual"))


def _groups(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("mz"), (F.col("p_size") % 3 + 2).alias("charge"), (F.col("p_partkey").cast("double") / 100).alias("rt"))


def _runs(spark, d):
    return st.run_names(series(spark, d))


#: The given tables' runs, for the SQL, which cannot take them from the data; the queries do.
RUNS = ["click", "error", "purchase", "signup", "view"]
_SCORES_SQL = "with s as (select n_chars as score, toxic = 1 as decoy from documents join labels using (doc_id)), c as (select score, count(*) filter (not decoy) as t, count(*) filter (decoy) as d from s group by score)"
_ENTRIES_SQL = "with s as (select doc_id as id, n_chars::double as score, toxic = 1 as decoy from documents join labels using (doc_id))"
_CELLS_SQL = f"with {SERIES_SQL}, cells as (select channel as row, run, sum(value)::bigint as intensity from series group by all)"


def _lines_sql() -> str:
    """Five rounds of clip and refit, written out; rows once cut stay out, and a run without spread is done."""
    out = [SERIES_SQL, "a0 as (select run, seq, seq::double as x, value::double as y from series)"]
    fit = "regr_slope(y, x) as slope, regr_intercept(y, x) as intercept"
    out.append(f"f0 as (select run, {fit} from a0 group by run)")
    for k in range(1, 6):
        out.append(f"s{k} as (select run, stddev_samp(y - slope * x - intercept) as sigma from a{k - 1} join f{k - 1} using (run) group by run)")
        out.append(f"a{k} as (select run, seq, x, y from a{k - 1} join f{k - 1} using (run) join s{k} using (run) where sigma < 1e-9 or abs(y - slope * x - intercept) <= 3 * sigma)")
        out.append(f"f{k} as (select run, {fit} from a{k} group by run)")
    return "with " + ", ".join(out)


def _line_sql() -> str:
    return _lines_sql() + " select run, round(slope, 5) as slope, round(intercept, 2) as intercept, count(*) as n from a5 join f5 using (run) group by all"


def _lines(spark, d):
    rows = series(spark, d).select("run", "seq", F.col("seq").cast("double").alias("x"), F.col("value").cast("double").alias("value"))
    return rows, st.clipped_line(rows)


def _line(spark, d):
    return _lines(spark, d)[1].select("run", F.round("slope", 5).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


def _spread(spark, d):
    rows, lines = _lines(spark, d)
    left = st.kept_rows(rows, lines).withColumn("residual", F.col("value") - F.col("slope") * F.col("x") - F.col("intercept"))
    extent = rows.groupBy("run").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    left = left.join(F.broadcast(extent), "run").select("run", ((F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))).alias("x"), "residual")
    return st.spread_bins(left).withColumn("sigma", F.round("sigma", 2))


def _surface(spark, d):
    return st.recalibration_surface(_residuals(spark, d)).select("mz_bin", "rt_bin", "n", "centre", F.round("spread", 6).alias("spread"))


def _q(spark, d, conservative=False):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), (F.col("toxic") == 1).alias("decoy"))
    return st.target_decoy_q(rows, conservative).withColumn("q", F.round("q", 9))


QUERIES = {
    "hil_traces": lambda s, d: tr.traces(peaks(s, d)),
    "hil_moments": lambda s, d: tr.moments(peaks(s, d)),
    "hil_gap_fill_smooth": lambda s, d: tr.filled(peaks(s, d)),
    "hil_shape_score": lambda s, d: tr.shape(peaks(s, d)),
    "sco_estimators": lambda s, d: tr.estimators(peaks(s, d)),
    "fea_band_join": lambda s, d: tr.overlapping(tr.traces(peaks(s, d)), TOLERANCE),
    "fea_coelution_cosine": lambda s, d: tr.coelution(tr.profiles(peaks(s, d)), tr.overlapping(tr.traces(peaks(s, d)), TOLERANCE).drop("overlap")),
    "pre_rolling_scale": lambda s, d: st.rolling_scale(series(s, d)),
    "sco_element_counts": lambda s, d: st.element_counts(_masses(s, d)),
    "sco_affinities": lambda s, d: st.affinities(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("profile"))),
    "aln_reference_run": lambda s, d: st.reference_run(series(s, d), 10_000),
    "aln_normalised_time": lambda s, d: st.normalised_time(series(s, d)),
    "aln_clipped_line": _line,
    "aln_spread_bins": _spread,
    "lfq_target_decoy_q": _q,
    "lfq_conservative_q": lambda s, d: _q(s, d, True),
    "con_group_q": lambda s, d: st.group_q(_scores(s, d).where("not decoy"), _scores(s, d).where("decoy"), 4).withColumn("q", F.round("q", 9)),
    "lfq_median_ratio": lambda s, d: st.median_ratio(_cells(s, d)).withColumn("factor", F.round("factor", 6)),
    "lfq_matrix": lambda s, d: st.matrix(_cells(s, d), _runs(s, d)),
    "src_dia_schedule": lambda s, d: st.dia_schedule(table(s, d, "lineitem").select(F.col("l_suppkey").alias("run"), F.expr("cast(l_quantity as bigint)").alias("window"))),
    "tgt_donors": lambda s, d: st.donors(series(s, d).select("run", F.col("channel").alias("peptide"), (F.col("seq") % 3).alias("charge"), (F.col("value") % 100).alias("q"), F.col("value").alias("score"), "seq")),
    "hil_median_of_three": lambda s, d: tr.median_of_three(peaks(s, d)),
    "fea_recal_surface": _surface,
    "fea_noise_floor": lambda s, d: st.noise_floor(tr.traces(peaks(s, d)).select((F.col("channel") % 2).alias("run"), F.col("intensity_max").alias("apex"))),
    "lfq_cells": lambda s, d: st.cells(_groups(s, d), _runs(s, d)),
    "snk_run_report": lambda s, d: st.run_report(tr.traces(peaks(s, d))),
}

ORACLE_SQL = {
    "hil_traces": WITH_TRACES + "select * from traces",
    "hil_moments": WITH_TRACES + """, m as (
  select channel, trace, count(*) as n, sum(w) as sw, sum(w * w) as sww, sum(w * x) as swx, sum(w * x * x) as swxx
  from (select *, intensity::double as w, mz_weighted::double / intensity as x from members) group by all having count(*) >= 3
), v as (select *, swx / sw as mean, sqrt(greatest(0, swxx / sw - (swx / sw) * (swx / sw))) as sd from m)
select channel, trace, round(mean, 6) as mz, round(sd, 4) as mz_std, round(sd / sqrt(greatest(1, sw * sw / sww)), 4) as mz_se from v""",
    "hil_gap_fill_smooth": WITH_TRACES + """, n as (
  select *, lead(scan) over w as s2, lead(intensity) over w as i2 from members window w as (partition by channel, trace order by scan)
), f as (
  select channel, trace, (scan + k)::int as scan, intensity + case when k > 0 then (i2 - intensity) * k::double / (s2 - scan) else 0 end as v, k > 0 as gap
  from n, range(0, coalesce(s2 - scan, 1)) r(k)
) select channel, trace, scan, round(v, 4) as value, gap, round(avg(v) over (partition by channel, trace order by scan rows between 1 preceding and 1 following), 4) as smooth from f""",
    "hil_shape_score": ZEROS + """, a as (select *, max(v) over (partition by channel, trace) as top, lag(v) over (partition by channel, trace order by scan) as b from z),
x as (select channel, trace, max(scan) filter (v = top) as apex from a group by all)
select channel, trace, round(avg(case when scan <= apex then (v >= b)::int else (v <= b)::int end) filter (b is not null), 6) as shape from a join x using (channel, trace) group by all""",
    "sco_estimators": ZEROS + """, a as (
  select *, row_number() over (partition by channel, trace order by v desc, scan) as nth, sum(v) over (partition by channel, trace order by scan rows between 4 preceding and current row) as five,
    lag(v) over w as a, lead(v) over w as c from z window w as (partition by channel, trace order by scan)
) select channel, trace, round(sum(v) filter (nth <= 5), 3) as scattered5, round(max(five) filter (scan - scan_start >= least(4, scan_end - scan_start)), 3) as consecutive5,
  round(max(case when nth = 1 then case when a - 2 * v + c < 0 then v - (c - a) * (c - a) / (8 * (a - 2 * v + c)) else v end end), 3) as parabolic from a group by all""",
    "fea_band_join": WITH_TRACES + f"""select a.channel as channel_a, a.trace as trace_a, b.channel as channel_b, b.trace as trace_b,
  least(a.scan_end, b.scan_end) - greatest(a.scan_start, b.scan_start) + 1 as overlap
from traces a join traces b on b.intensity_max >= a.intensity_max and b.intensity_max <= a.intensity_max * (1 + {TOLERANCE}::double)
  and least(a.scan_end, b.scan_end) - greatest(a.scan_start, b.scan_start) + 1 >= 3 and (a.channel, a.trace) <> (b.channel, b.trace)""",
    "fea_coelution_cosine": WITH_TRACES + f""", p as (select a.channel as ca, a.trace as ta, b.channel as cb, b.trace as tb
from traces a join traces b on b.intensity_max >= a.intensity_max and b.intensity_max <= a.intensity_max * (1 + {TOLERANCE}::double)
  and least(a.scan_end, b.scan_end) - greatest(a.scan_start, b.scan_start) + 1 >= 3 and (a.channel, a.trace) <> (b.channel, b.trace)
), n as (select channel, trace, sqrt(sum(intensity::double * intensity)) as norm from members group by all),
d as (select ca, ta, cb, tb, coalesce(sum(x.intensity::double * y.intensity), 0) as dot from p join members x on x.channel = ca and x.trace = ta
  left join members y on y.channel = cb and y.trace = tb and y.scan = x.scan group by all)
select ca as channel_a, ta as trace_a, cb as channel_b, tb as trace_b, round(dot / (u.norm * v.norm), 6) as cosine
from d join n u on u.channel = ca and u.trace = ta join n v on v.channel = cb and v.trace = tb""",
    "pre_rolling_scale": f"with {SERIES_SQL}, m as (select *, median(value) over (partition by channel order by seq rows between 5 preceding and 5 following) as md from series) select channel, seq, round(case when value = 0 then 3.0 else greatest(0.5, least(3.0, md::double / value)) end, 9) as scale from m",
    "sco_element_counts": "select p_partkey as id, " + ", ".join(f"floor({x}::double * p_retailprice::double / {st.RESIDUE_MASS}::double + 0.5)::bigint as n_{e.lower()}" for e, x in st.RESIDUE.items()) + " from part",
    "sco_affinities": """with v as (select vec_id as id, list_transform(embedding, lambda x: abs(x::double)) as p from embeddings),
b as (select a.id, a.p, c.p as q from v a join v c on c.id = a.id + 1)
select id, round(list_sum(list_transform(list_zip(p, q), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(p) * list_sum(q)), 6) as affinity,
  round(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(p, lambda x: x * x)) * list_sum(list_transform(q, lambda x: x * x))), 6) as cosine from b""",
    "aln_reference_run": f"with {SERIES_SQL} select run, count(*) filter (value >= 10000) as n from series group by run order by n desc, run desc limit 1",
    "aln_normalised_time": f"with {SERIES_SQL}, e as (select run, min(seq) as low, max(seq) as high from series group by run) select run, seq, round(case when high = low then 0.5 else (seq - low)::double / (high - low) end, 9) as rt from series join e using (run)",
    "aln_clipped_line": _line_sql(),
    "aln_spread_bins": _lines_sql() + """, e as (select run, min(x) as low, max(x) as high from a0 group by run),
r as (select run, y - slope * x - intercept as r, least(11, floor((x - low) / (high - low) * 12)::int) as bin from a5 join f5 using (run) join e using (run)),
g as (select run, var_samp(r) as whole from r group by run), o as (select run, bin, count(*) as n, coalesce(var_samp(r), 0) as own from r group by all),
b as (select run, whole, k::int as bin from g, range(12) t(k))
select run, bin, coalesce(n, 0) as n, round(greatest(sqrt((coalesce(n, 0) * coalesce(own, 0) + 20 * whole) / (coalesce(n, 0) + 20)), 0.25 * sqrt(whole)), 2) as sigma from b left join o using (run, bin)""",
    "lfq_target_decoy_q": f"""{_ENTRIES_SQL}, r as (select *, sum((not decoy)::int) over w as nt, sum(decoy::int) over w as nd from s window w as (order by score desc, id rows unbounded preceding)),
m as (select *, min(case when decoy then 1.0 else nd::double / nt end) over (order by score, id desc rows unbounded preceding) as q from r)
select id, score, decoy, round(case when decoy then 1.0 else least(1.0, q) end, 9) as q from m""",
    "lfq_conservative_q": f"""{_ENTRIES_SQL}, c as (select score, count(*) filter (not decoy) as t, count(*) filter (decoy) as d from s group by score),
r as (select *, case when t > 0 then least(1.0::double, (1 + sum(d) over w)::double / sum(t) over w) else 1.0 end as rate from c window w as (order by score desc rows unbounded preceding)),
m as (select *, min(rate) over (order by score rows unbounded preceding) as q from r)
select id, score, decoy, round(case when decoy then 1.0 else q end, 9) as q from s join m using (score)""",
    "con_group_q": f"""{_SCORES_SQL}, r as (select *, case when t > 0 and score > 0 then least(1.0::double, (1 + (sum(d) over w)::double / 4) / sum(t) over w) else 1.0 end as rate from c window w as (order by score desc rows unbounded preceding)),
q as (select *, min(rate) over (order by score rows unbounded preceding) as q from r)
select score::double as score, t as n, round(case when score <= 0 then 1.0 else q end, 9) as q from q where t > 0""",
    "lfq_median_ratio": f"""{_CELLS_SQL}, x as (select row, run, log2(intensity::double) as x from cells where intensity > 0),
m as (select row, avg(x) as mean from x group by row having count(*) = (select count(distinct run) from cells)),
f as (select run, median(x - mean) as f from x join m using (row) group by run) select run, round(f - (select median(f) from f), 6) as factor from f""",
    "lfq_matrix": f"{_CELLS_SQL} select row, " + ", ".join(f"coalesce(sum(intensity) filter (run = '{r}'), 0)::bigint as {r}" for r in RUNS) + " from cells group by row",
    "src_dia_schedule": "with s as (select l_suppkey as run, count(*) as n_scans, count(distinct l_quantity::bigint) as n_windows from lineitem group by 1) select *, n_scans >= 8 and n_windows between 1 and 2000 and n_scans::double / n_windows >= 3.0 as is_dia from s",
    "tgt_donors": f"with {SERIES_SQL}, p as (select run, channel as peptide, seq % 3 as charge, value % 100 as q, value as score, seq from series) select * from p qualify row_number() over (partition by run, peptide, charge order by q, score desc, seq) = 1",
    "hil_median_of_three": WITH_TRACES + """, t as (select *, lag(intensity) over w as a, lead(intensity) over w as c from members window w as (partition by channel, trace order by scan))
select channel, trace, scan, case when a is null or c is null then intensity else list_sort([a, intensity, c])[2] end as value from t""",
    "fea_recal_surface": """with r as (select l_quantity::bigint as mz, l_suppkey as rt, (round(l_extendedprice * 100)::bigint % 1000 - 500)::double as residual from lineitem),
e as (select min(mz) as ml, max(mz) as mh, min(rt) as rl, max(rt) as rh from r),
b as (select least(19, floor((mz - ml) * 20 / ((mh - ml) * (1 + 1e-9::double))))::int as m, least(7, floor((rt - rl) * 8 / ((rh - rl) * (1 + 1e-9::double))))::int as t, residual from r, e),
l as (select m as mz_bin, t as rt_bin, residual from b union all select m, -1, residual from b union all select -1, -1, residual from b),
c as (select mz_bin, rt_bin, count(*) as n, median(residual) as centre from l group by all having rt_bin < 0 or count(*) >= 50)
select mz_bin, rt_bin, n, centre, round(1.4826::double * median(abs(residual - centre)), 6) as spread
from l join c using (mz_bin, rt_bin) group by all""",
    "fea_noise_floor": WITH_TRACES + """, o as (select channel % 2 as run, intensity_max, row_number() over (partition by channel % 2 order by intensity_max) - 1 as i, count(*) over (partition by channel % 2) as n from traces)
select run, round(intensity_max * 0.8::double, 3) as floor from o where i = floor(0.05::double * n)""",
    "lfq_cells": "with g as (select p_partkey as id, p_retailprice::double as mz, p_size % 3 + 2 as charge, p_partkey::double / 100 as rt, (max(p_partkey::double / 100) over ()) - (min(p_partkey::double / 100) over ()) as span from part) select id, run, decoy, round(mz + decoy::int * 11.0::double / charge, 6) as mz, round(rt - decoy::int * 0.01::double * span, 6) as rt from g, unnest(" + repr(RUNS) + ") r(run), unnest([false, true]) d(decoy)",
    "snk_run_report": WITH_TRACES + "select channel % 2 as run, count(*) as n, median(n_scans)::double as median_scans, median(intensity_max)::double as median_apex, round(stddev_samp(n_scans), 6) as std_scans from traces group by 1",
}

QUERIES |= signal.QUERIES
ORACLE_SQL |= signal.ORACLE_SQL
