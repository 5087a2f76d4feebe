"""Mixing sources to target weights as a time-varying curriculum.

Targets.  Sources in code point order (null last) weigh 5, 2, 1, repeating, and
share 150 % of all words; a target stops at twice its source's size, and the
excess goes to the others by weight until none is above.  That is one level
``L`` with target = min(weight * L, 2 * size): the sources are sorted by the
level at which they fill, and prefix sums give L in one pass.

Positions.  A source's weight moves linearly over training, from ``start`` to
``end`` times its mean (5s fade out, the others fade in).  Integrated, the
schedule is the source's cumulative demand at a time t in [0, 1]; the words of
a source, laid out in the order of a hash of doc_id (one lap over the source,
then a second), are given the time at which demand reaches them, by inverting
the integral; a document that both laps take has two positions.  The mix is
range-sorted by that time.

A source's words are laid out by two-level prefix sums: hash-ranged slices of a
source are summed and cumulated, then each slice is numbered on its own, so a
source of any size spreads over ``SLICES`` groups.

Edge cases: null or wordless texts have size 0 and take nothing; a null source
is a source; rows that share a doc_id are laid out side by side, in the order
of their texts' hash; null doc_ids likewise; an empty table gives an empty
result; columns besides doc_id, text and source pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import held, released, table, word_count

WEIGHTS, SHARE, LAPS = (5, 2, 1), 1.5, 2
#: A source's weight at the start and the end of training, as a multiple of its mean, by its place in WEIGHTS.
SCHEDULES = ((1.5, 0.5), (0.75, 1.25), (0.5, 1.5))
#: Hash-ranged slices that each source is laid out in (three hex digits).
SLICES = 3


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size, order (hex digest), slice (its first digits)."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count("text").alias("size"))
    # Rows without an id are told apart by their texts, else they would fill one slice.
    rows = rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text_hash").cast("string"))))
    return rows.withColumn("slice", F.substring("order", 1, SLICES))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, place (0, 1, 2: whose weight and schedule), target from source, source_size."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("place", (F.row_number().over(by_name) - 1) % len(WEIGHTS))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") + 1).cast("int")).cast("double"))
    rows = rows.withColumn("most", (LAPS * F.col("source_size")).cast("double")).withColumn("fills_at", F.col("most") / F.col("weight"))
    filling = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    wanted = F.lit(SHARE) * F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("level", (wanted - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The level is the first that its own source does not fill at; sources before it are full.
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(Window.partitionBy())["level"]
    rows = rows.withColumn("target", F.least("most", F.col("weight") * F.coalesce(level, F.lit(float("inf")))))
    return rows.select("source", "source_size", "place", "target")


def layout(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, place, target, begin: a row's words follow ``begin`` others of its source."""
    rows = _sized(docs)
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_begin", F.coalesce(F.sum("slice_size").over(upto), F.lit(0))).withColumn("has", F.col("source").isNotNull())
    aims = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))).withColumn("has", F.col("source").isNotNull())
    filled = lambda df: df.withColumn("source", F.coalesce("source", F.lit("")))  # noqa: E731  joins on (has, source): null matches null
    slices = filled(slices).join(filled(aims), ["has", "source"])
    inside = Window.partitionBy("has", "source", "slice").orderBy("order", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = filled(rows.withColumn("has", F.col("source").isNotNull())).withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(slices, ["has", "source", "slice"])
    source = F.when(F.col("has"), F.col("source"))
    return placed.select("doc_id", source.alias("source"), "text_hash", "size", "source_size", "place", "target", (F.col("slice_begin") + F.col("inner")).alias("begin"))


def _words_of(lap: int):
    """Words that a lap takes of a row: those before the source's rounded target."""
    begin = F.col("begin") + lap * F.col("source_size")
    end = F.least(F.floor(F.col("target") + 0.5), LAPS * F.col("source_size"))
    return F.greatest(F.lit(0), F.least(F.col("size"), end - begin)).cast("long")


def _time(lap: int):
    """When the curriculum's demand reaches the middle of a lap's words of a row."""
    start = F.element_at(F.array(*[F.lit(a) for a, _ in SCHEDULES]), (F.col("place") + 1).cast("int"))
    slope = F.element_at(F.array(*[F.lit(b - a) for a, b in SCHEDULES]), (F.col("place") + 1).cast("int"))
    share = (F.col("begin") + lap * F.col("source_size") + F.col(f"lap{lap}") / 2) / F.col("target")
    # Integral: start * t + slope * t^2 / 2 = share (start + slope / 2 = 1).
    return 2 * share / (start + F.sqrt(start * start + 2 * slope * share))


def schedule(docs: DataFrame) -> DataFrame:
    """``layout`` with lap0, lap1 (words taken on each lap) and time0, time1 (null where none)."""
    rows = layout(docs)
    for lap in range(LAPS):
        rows = rows.withColumn(f"lap{lap}", _words_of(lap))
        rows = rows.withColumn(f"time{lap}", F.when(F.col(f"lap{lap}") > 0, _time(lap)))
    return rows


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in training order, once for each lap that takes half their words or more."""
    laps = F.array(*[F.when(2 * F.col(f"lap{i}") >= F.col("size"), F.col(f"time{i}")) for i in range(LAPS)])
    taken = schedule(docs).select("doc_id", "source", "text_hash", F.array_compact(laps).alias("times")).where(F.size("times") > 0)
    has_id, has_source = F.col("doc_id").isNotNull(), F.col("source").isNotNull()
    key = F.xxhash64(has_id, "doc_id", has_source, "source", "text_hash").alias("key")
    # Rows repeated in full share a key: they take the laps of the key's rows in turn, whichever takes which.
    nth = lambda order: F.row_number().over(Window.partitionBy("key").orderBy(order))
    plans = taken.select(key, "times").withColumn("nth", nth("times"))
    keyed = held(docs, key=F.xxhash64(has_id, "doc_id", has_source, "source", F.xxhash64("text")))
    keyed = keyed.withColumn("nth", nth("key")).join(plans, ["key", "nth"])
    return released(keyed.select("row", F.explode("times").alias("time")).orderBy("time", "row.doc_id"))


def op5_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schedule(table(spark, sf_dir, "documents"))
    first, again = F.coalesce("time0", "time1"), F.when(F.col("time0").isNotNull(), F.col("time1"))
    rows = rows.select("doc_id", "size", "source_size", "target", (F.col("lap0") + F.col("lap1")).alias("taken"), first.alias("position"), again.alias("position_again"))
    return rows.orderBy("position", "doc_id")


OP5_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size, md5(coalesce(doc_id::varchar, '')) as o from documents
), sizes as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, ((row_number() over (order by source nulls last)) - 1) % 3 as place from sizes),
weighed as (select *, [5.0, 2.0, 1.0][place + 1]::double as weight, (2 * source_size)::double as most, (2 * source_size)::double / [5.0, 2.0, 1.0][place + 1]::double as fills_at from ranked),
levels as (
  select *, (1.5::double * (sum(source_size) over ()) - coalesce(sum(most) over (order by fills_at, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by fills_at, source nulls last rows between current row and unbounded following) as level from weighed
), one as (select arg_min(level, fills_at) as level from levels where level <= fills_at),
aims as (select l.source, l.source_size, l.place, least(l.most, l.weight * coalesce(one.level, 'inf'::double)) as target from levels l, one),
placed as (
  select s.doc_id, s.size, a.source_size, a.place, a.target,
    coalesce(sum(s.size) over (partition by s.source order by s.o, s.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as b
  from sized s join aims a on s.source is not distinct from a.source
), laps as (
  select *, greatest(0, least(size, least(floor(target + 0.5)::bigint, 2 * source_size) - b))::bigint as lap0,
    greatest(0, least(size, least(floor(target + 0.5)::bigint, 2 * source_size) - b - source_size))::bigint as lap1 from placed
), shares as (
  select *, [1.5, 0.75, 0.5][place + 1]::double as a, [-1.0, 0.5, 1.0][place + 1]::double as c,
    case when lap0 > 0 then (b + lap0::double / 2) / target end as q0, case when lap1 > 0 then (b + source_size + lap1::double / 2) / target end as q1 from laps
), times as (select *, 2 * q0 / (a + sqrt(a * a + 2 * c * q0)) as t0, 2 * q1 / (a + sqrt(a * a + 2 * c * q1)) as t1 from shares)
select doc_id, size, source_size, target, lap0 + lap1 as taken, coalesce(t0, t1) as position, case when t0 is not null then t1 end as position_again from times
"""
