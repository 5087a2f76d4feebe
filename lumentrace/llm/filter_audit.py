"""Filter interaction audit: what each filter removes in every order of the filters.

Each document becomes a mask, bit k set where filter k rejects it.  Documents
are counted by (part, mask, quality, toxicity), which leaves 2^filters times
four cells a part at most.  Cells are unpivoted against the steps of all
orders; in the window of a cell and an order the running bit-or of the steps'
failing bits up to the one before tells whether the cell went earlier, and
conditional sums over the cells make the figures of each step.  A filter's
removals over all orders are the total of its window.

Whether a text repeats one of a smaller doc_id is found without moving texts:
rows are counted by (doc_id, SHA-256 of the text), joined to their labels, and
counted again by digest with the rows at the least doc_id kept apart, both with
map-side partial sums, so copies of one text are few rows before any shuffle
by digest.

Edge cases: a null text is an empty one, a null part the empty string; a null
doc_id is greater than any other and has no labels; rows of one doc_id and text
do not repeat each other; labels that repeat a doc_id count as 1 where any of
them is 1; null labels are not 1; an empty table gives no rows; columns besides
doc_id, text and the part are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import WORD, table

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
#: Letter of the filter that looks at other documents.
REPEATS = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Letter -> whether a text (not null) fails: few words, few distinct words, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    count, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long")
    return {
        "A": count < LEAST_WORDS,
        "B": 100 * distinct < LEAST_DISTINCT * count,
        "C": 100 * capitals > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang", filters=text_filters) -> tuple[DataFrame, str]:
    """(part, mask, good, toxic, n), letters: bit k of ``mask`` is the k-th letter's verdict, the last one ``REPEATS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tests = filters(text)
    letters = "".join(tests) + REPEATS
    mask = sum((c.cast("int") * (1 << k) for k, c in enumerate(tests.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flags = flags.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(flags, "doc_id", "left").na.fill(False, ["good", "toxic"])
    # A null doc_id comes last; a group's rows at its least doc_id are one row by now.
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    kinds = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(place.alias("place"), F.col("n"))).alias("first"))
    least = F.min("first.place").over(Window.partitionBy("digest"))  # a row for each part and pair of labels
    kinds = kinds.withColumn("kept", F.when(F.col("first.place") == least, F.col("first.n")).otherwise(0))
    verdicts = F.array(*[F.struct(F.lit(bit).alias("bit"), n.alias("n")) for bit, n in ((0, F.col("kept")), (1 << len(tests), F.col("n") - F.col("kept")))])
    each = kinds.select("part", "mask", "good", "toxic", F.inline(verdicts)).where("n > 0")
    return each.groupBy("part", (F.col("mask") + F.col("bit")).alias("mask"), "good", "toxic").agg(F.sum("n").alias("n")), letters


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and step."""
    orders = F.array(*[F.lit("".join(o)) for o in permutations(letters)])
    # The parts' cells, one row a mask, with the sums that the figures are made of.
    masks = counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"))
    steps = masks.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).where("filter <> ''")
    bit = F.coalesce(*[F.when(F.col("filter") == letter, 1 << k) for k, letter in enumerate(letters)])
    steps = steps.select("part", "mask", "n", "n_good", "n_toxic", "filter_order", (F.col("at") + 1).alias("step"), "filter", bit.alias("bit")).withColumn("failing", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("failing").over(before), F.lit(0)))
    fails, gone = F.col("failing") != 0, F.col("earlier") != 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0))
    figures = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "n_good").alias("good_lost"), total(fails & ~gone, "n_toxic").alias("toxic_lost"),
    )
    return figures.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(*cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: DuckDB: each document's mask against each order, with lists in place of windows.
OP11_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), f as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
m as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    (case when len(words) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end)
    || (case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) then 'C' else '' end)
    || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end) || (case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end) as failing
  from d left join f using (doc_id)
), c as (select part, failing, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as t from m group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
o as (select a.l || b.l || c.l || d.l || e.l as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s as (select filter_order, k::int as step, substr(filter_order, k::int, 1) as filter, substr(filter_order, 1, k::int - 1) as before from o, range(1, 6) r(k)),
x as (select *, contains(failing, filter) as fails, len(list_filter(string_split(failing, ''), lambda z: z <> '' and contains(before, z))) > 0 as gone from c, s),
r as (
  select part, filter_order, step, filter, coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept, coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed,
    coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant, coalesce(sum(n) filter (failing = filter), 0)::bigint as unique_fails,
    coalesce(sum(g) filter (fails and not gone), 0)::bigint as good_lost, coalesce(sum(t) filter (fails and not gone), 0)::bigint as toxic_lost from x group by all
) select *, (sum(removed) over (partition by part, filter))::bigint as shapley from r
"""
