"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions.

Lines are compared as words: lower case, white space runs folded.  Two lines
are near when their word edit distance (insert, delete, replace one word) is
within the bound of the shorter: 0 below ``EDIT_FROM`` words, else 1.  A line
goes when an equal or near line stands earlier, by (doc_id, line number).
Lines without words always stay.

The join never makes pairs of a large group:

* Texts are cut into lines once; their hashes are written down, and all but the
  texts of lines in question is read from there.
* Equal lines are folded to their earliest place first (map-side combined).
* A cheap filter finds lines that can have a near partner at all: one edit
  leaves either the first or the last half of the words alone, so lines whose
  opening and closing are both unique are done.
* Lines of n and of n + 1 words are grouped by their first and by their last half.
  Of up to ``FEW`` lines in a group, each is compared with the earlier ones.
* Only what is left of the lines of larger groups is halved and grouped again, by
  all that was left out, until groups are small or ``SHORT`` words are left.  So what
  is left makes two rows a round, not one for each of its words.
* Only these few words emit their deletion variants as hashed keys.  Variants that
  lack the same position are equal exactly when one word differs: each such group
  yields its earliest line.  A variant equal to a whole part is one inserted word:
  each variant joins one folded line at most.
* The edit distance of each surviving (line, earlier line) is then verified on
  their words.

Edge cases: null text stays null and has no lines; rows without a doc_id stand
before all others; rows that share a doc_id, or have none, stand in the order of
a hash of their texts; of wholly repeated rows (told apart by their places in
the table, so reading it twice must give one order, as files do) one keeps its
lines and the others lose all that have words; empty tables give empty results;
columns besides doc_id and text pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.llm.common import cut_lineage, held, table

#: Words from which a line may differ by one.
EDIT_FROM = 8
#: Words of the shortest opening or closing. A line of n words has one of k words for the greatest k = 2^i - 1 with
#: 2k + 1 <= n; a line of just 2k + 1 words also has the next smaller, for its partners with a word less.
LEAST_END = 3
#: Lines that share a first or last half and are compared in pairs, at most; the rest of those of larger groups is halved again.
FEW = 8
#: Words left of a line that are not halved any more: in larger groups they go by their variants.
SHORT = 8
#: A bitmap grows with the number of its values, by powers of two, up to so many words of 64 bits.
MOST_BITMAP_WORDS = 1 << 21
SPACES = " \t\n\v\f\r"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, _text_hash, text: what tells a row of documents from others."""
    return docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), "text")


def _row_key(doc_id, text_hash):
    return F.xxhash64(doc_id.isNull(), doc_id, text_hash)


def _with_gone(docs: DataFrame, **computed) -> DataFrame:
    """row (a struct of the columns of ``docs``), the computed columns, gone (null where no lines go), again (a repeated row)."""
    rows = held(docs, key=_row_key(F.col("doc_id"), F.xxhash64("text")), place=F.monotonically_increasing_id(), **computed)
    gone = repeated_lines(docs).select(_row_key(F.col("doc_id"), F.col("_text_hash")).alias("key"), F.col("_gone").alias("gone"))
    copies = rows.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    marks = gone.join(copies, "key", "full")
    return rows.join(marks, "key", "left").withColumn("again", F.coalesce(F.col("place") != F.col("first"), F.lit(False)))


def _bound(value, body):
    """``body`` of a value that is computed once for a row, however often the body's lambdas read it."""
    return F.transform(F.array(value), body)[0]


def _worded(line):
    """Whether a line has words: what is left of it by its first word, as trimming both sides reads all of it."""
    return F.ltrim(line, F.lit(SPACES)) != ""


def _norm(line):
    """Lower-case words, one space apart; lines that have single spaces only need no pattern."""
    line = F.lower(line)
    odd = F.contains(line, F.lit("  "))
    for space in SPACES[1:].replace("\n", ""):
        odd = odd | F.contains(line, F.lit(space))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def _n_words():
    return F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1


def _key(*parts) -> list:
    return [F.xxhash64(*parts).alias("h1"), F.hash(*parts).alias("h2")]


def _lines(keyed: DataFrame) -> DataFrame:
    """place, line; only lines with words."""
    lines = keyed.select("doc_id", "_text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(_worded(F.col("line"))).select(F.struct("doc_id", "_text_hash", "line_no").alias("place"), "line")


def _hashes(keyed: DataFrame) -> DataFrame:
    """place, as_is (the line's hash), h1, h2 (those of its words), n_words, ends of lines with words."""
    lines = _lines(keyed).select("place", F.xxhash64("line").alias("as_is"), _norm(F.col("line")).alias("norm"))
    lines = lines.select("place", "as_is", *_key("norm"), "norm", _n_words().alias("n_words"))
    return _with_ends(lines).drop("norm")


def _with_ends(lines: DataFrame) -> DataFrame:
    """``lines`` with ends: hashes of a line's openings and closings (array; null of lines that must be equal)."""
    longest, half = F.col("_longest"), F.shiftright("_longest", 1)
    end = lambda k: F.array(F.xxhash64(F.lit("first"), k, F.call_function("substring_index", F.col("norm"), F.lit(" "), k)), F.xxhash64(F.lit("last"), k, F.call_function("substring_index", F.col("norm"), F.lit(" "), -k)))
    both = (F.col("n_words") == 2 * longest + 1) & (half >= LEAST_END)
    ends = F.when(F.col("n_words") >= EDIT_FROM, F.when(both, F.concat(end(longest), end(half))).otherwise(end(longest)))
    lines = lines.withColumn("_longest", F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.col("n_words") + 1)) - 2) - 1)
    return lines.withColumn("ends", ends).drop("_longest")


def _in_bitmap(rows: DataFrame, of: str, values: DataFrame) -> DataFrame:
    """``rows`` whose hash ``of`` is one of the values (one column), and a few others."""
    # 16 bits a value, at most MOST_BITMAP_WORDS rows of 16 bytes: this spares most rows the exact join.
    words = 1 << max(10, min(MOST_BITMAP_WORDS.bit_length() - 1, (values.count() // 4).bit_length()))
    word = lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(words - 1))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    value = F.col(values.columns[0])
    bitmap = values.select(word(value).alias("word"), bit(value).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumn("word", word(F.col(of))).join(F.broadcast(bitmap), "word").where(F.col("bits").bitwiseAND(bit(F.col(of))) != 0).drop("word", "bits")


def _candidates(keyed: DataFrame, hashes: DataFrame) -> DataFrame:
    """id (h1), h2, place (earliest), n_words, norm of distinct lines that share an opening or a closing with another."""
    ends = hashes.select("h1", "h2", "place", "as_is", "n_words", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("end")
    shared = cut_lineage(shared)
    passed = _in_bitmap(ends, "end", shared).join(shared, "end")  # inner, on distinct keys: a semi join would be moved below the bitmap
    found = passed.groupBy("h1", "h2").agg(F.min(F.struct("place", "as_is")).alias("first"), F.first("n_words").alias("n_words"))
    found = cut_lineage(found.select("h1", "h2", "first.place", "first.as_is", "n_words"))
    # Only these lines' texts are fetched.
    lines = _in_bitmap(_lines(keyed).select("line", F.xxhash64("line").alias("as_is")), "as_is", found.select("as_is"))
    norms = lines.select(_norm(F.col("line")).alias("norm")).select(*_key("norm"), "norm").groupBy("h1", "h2").agg(F.first("norm").alias("norm"))
    return found.join(norms, ["h1", "h2"]).select(F.col("h1").alias("id"), "h2", "place", "n_words", "norm")


def _near(a, b):
    """Whether two word arrays differ by one edit at most: what the common opening and closing leave."""
    shorter = F.least(F.size(a), F.size(b))
    steps = F.sequence(F.lit(0), shorter - 1)
    opening = F.aggregate(steps, F.lit(0), lambda n, i: F.when((n == i) & (F.get(a, i) == F.get(b, i)), n + 1).otherwise(n))
    closing = F.aggregate(steps, F.lit(0), lambda n, i: F.when((n == i) & (F.get(a, F.size(a) - 1 - i) == F.get(b, F.size(b) - 1 - i)), n + 1).otherwise(n))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (opening + closing >= F.greatest(F.size(a), F.size(b)) - 1)


def _halves(parts: DataFrame) -> DataFrame:
    """``parts`` without the first and without the last half of the words that were left; key tells what was left out so far."""
    half = F.shiftright("n_left", 1)
    first, last = (F.call_function("substring_index", F.col("rest"), F.lit(" "), k) for k in (half, -half))
    without = F.array(
        F.struct(F.xxhash64("key", F.lit("first"), first).alias("key"), F.substring("rest", F.length(first) + 2, F.length("rest")).alias("rest")),
        F.struct(F.xxhash64("key", F.lit("last"), last).alias("key"), F.substring("rest", F.lit(1), F.length("rest") - F.length(last) - 1).alias("rest")),
    )
    return parts.select("id", "place", "longer", (F.col("n_left") - half).alias("n_left"), F.explode(without).alias("part")).select("id", "place", "longer", "n_left", "part.*")


def _near_pairs(words: DataFrame) -> DataFrame:
    """id, other: pairs of candidates among which each line that is near an earlier one has such a partner."""
    # A line of n words stands among those of n or n + 1, and as the longer one among those of n - 1 or n: n_left counts the shorter's words.
    lengths = F.array(F.struct(F.lit(False).alias("longer"), F.col("n_words").alias("n_left")), F.struct(F.lit(True).alias("longer"), (F.col("n_words") - 1).alias("n_left")))
    parts = words.select("id", "place", F.col("norm").alias("rest"), F.explode(lengths).alias("as")).select("id", "place", "rest", "as.*")
    parts = parts.where(F.col("n_left") >= EDIT_FROM).withColumn("key", F.xxhash64("n_left"))
    few, short = [], []
    while True:
        halves = _halves(parts)
        sizes = halves.groupBy("key").agg(F.count("*").alias("n"), F.bool_and("longer").alias("none_shorter"))
        sizes = cut_lineage(sizes.where("n > 1 and not none_shorter").select("key", "n"))
        halves = cut_lineage(halves.join(sizes, "key"))
        few.append(halves.where(F.col("n") <= FEW).select("key", "id", "place", "longer"))
        parts = halves.where(F.col("n") > FEW).drop("n")
        short.append(parts.where(F.col("n_left") <= SHORT))
        parts = parts.where(F.col("n_left") > SHORT)
        if parts.isEmpty():
            break
    groups = reduce(DataFrame.union, few).groupBy("key").agg(F.collect_list(F.struct("place", "id", "longer")).alias("lines"))  # FEW at most
    pairs = groups.select("lines", F.explode("lines").alias("late")).select("late", F.explode("lines").alias("early"))
    pairs = pairs.where("early.place < late.place and not (early.longer and late.longer)").select("late.id", F.col("early.id").alias("other"))
    return pairs.union(_equal_variants(reduce(DataFrame.union, short))).distinct()


def _equal_variants(parts: DataFrame) -> DataFrame:
    """id, other: pairs of parts with one key and equal variants that hold each part's earliest partner."""
    n_words = F.col("n_left") + F.col("longer").cast("int")
    each = parts.select("id", "place", "longer", "key", "rest", n_words.alias("n_words"), F.explode(F.sequence(F.lit(0), n_words - 1)).alias("gone"))
    before, after = (F.call_function("substring_index", F.col("rest"), F.lit(" "), k) for k in (F.col("gone"), F.col("gone") + 1 - F.col("n_words")))
    variants = each.select("id", "place", "longer", "gone", F.xxhash64("key", F.trim(F.concat(before, F.lit(" "), after))).alias("key"))
    # One word replaced: equal variants that lack the same position; each joins the group's earliest line.
    lacking = variants.where(~F.col("longer")).select("id", "place", F.xxhash64("gone", "key").alias("key"))
    groups = lacking.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min(F.struct("place", "id")).alias("first"))
    # Written down, so that the join stands by itself and a group of many lines can be split among tasks.
    groups = cut_lineage(groups.where("a < b").select("key", F.col("first.id").alias("other")))
    by_replacing = lacking.join(groups, "key").select("id", "other").where("id != other")
    # One word inserted: a variant that is another whole part.
    whole = parts.where(~F.col("longer")).select("id", F.xxhash64("key", "rest").alias("key"))
    inserted = whole.join(variants.where("longer").select("key", F.col("id").alias("other")), "key").select("id", "other")
    return by_replacing.union(inserted).union(inserted.select("other", "id"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, _text_hash, _gone (sorted numbers of the lines that go) of the documents that lose lines."""
    keyed = _keyed(docs)
    hashes = cut_lineage(_hashes(keyed))
    words = cut_lineage(_candidates(keyed, hashes))
    a, b = (words.select(F.col("id").alias(i), F.col("h2").alias(f"{i}_h2"), F.col("place").alias(f"{i}_place"), F.col("norm").alias(f"{i}_norm")) for i in ("id", "other"))
    pairs = _near_pairs(words).join(a, "id").join(b, "other").where("other_place < id_place")
    near = pairs.where(_bound(F.struct(F.split("id_norm", " ").alias("a"), F.split("other_norm", " ").alias("b")), lambda x: _near(x.a, x.b)))
    near = near.select(F.col("id").alias("h1"), F.col("id_h2").alias("h2"), F.lit(True).alias("near")).distinct()
    # A line goes if it is not the earliest of its equals, or if those are near an earlier line.
    places = hashes.select("h1", "h2", "place")
    lines = places.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    going = lines.join(near, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    # Written down, so that the join stands by itself and a line that many rows share can be split among tasks.
    found = places.join(cut_lineage(going), ["h1", "h2"]).where("near or first < place")
    return found.groupBy("place.doc_id", "place._text_hash").agg(F.sort_array(F.collect_set("place.line_no")).alias("_gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """row (a struct of the columns of ``docs``), text (without the repeated lines), changed."""
    rows = _with_gone(docs)
    lines = F.split("row.text", "\n")
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = _bound(lines, lambda lines: F.array_join(F.transform(kept(lines), lambda i: F.get(lines, i)), "\n"))
    wordless = F.array_join(F.filter(lines, lambda x: ~_worded(x)), "\n")
    text = F.when(F.col("again"), wordless).when(F.col("gone").isNull(), F.col("row.text")).otherwise(text)
    return rows.select("row", text.alias("text"), (F.col("again") | F.col("gone").isNotNull()).alias("changed"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with deduplicated texts; n_chars, where there is one, counts the new text's."""
    fresh = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        fresh["n_chars"] = F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return dedup_lines(docs).select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines with words, and the numbers (from 0, comma-joined) of those that go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    worded = F.coalesce(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(_worded(x), i)), lambda i: i.isNotNull()), F.array().cast("array<int>"))
    found = _with_gone(docs, worded=worded).select("row.doc_id", "worded", F.when(F.col("again"), F.col("worded")).otherwise(F.coalesce("gone", F.array().cast("array<int>"))).alias("gone"))
    return found.select("doc_id", F.size("worded").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_gone"), F.array_join("gone", ",").alias("gone"))


#: DuckDB: the same rule by variants in full (no filter, no hashes).
OP6_SQL = r"""
with lines as (
  select doc_id, i - 1 as line_no, trim(regexp_replace(lower(t[i]), '[\x20\x09-\x0D]+', ' ', 'g')) as norm
  from (select doc_id, string_split(text, chr(10)) as t from documents where text is not null), range(1, len(t) + 1) r(i)
), worded as (select * from lines where norm <> ''),
firsts as (select norm, min((doc_id, line_no)) as place, string_split(norm, ' ') as w from worded group by norm),
variants as (
  select norm, place, len(w) as n, i as gone, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') as v
  from firsts, range(1, len(w) + 1) r(i) where len(w) >= 8
), replaced as (select gone, v, min(place) as least from variants group by gone, v having count(*) > 1),
near as (
  select v.norm from variants v join replaced r on v.gone = r.gone and v.v = r.v where r.least < v.place
  union
  select case when f.place > v.place then f.norm else v.norm end
  from variants v join firsts f on f.norm = v.v where v.n > 8
), gone as (
  select w.doc_id, w.line_no from worded w join firsts f on f.norm = w.norm
  where (w.doc_id, w.line_no) > f.place or w.norm in (select norm from near)
)
select d.doc_id, (select count(*) from worded w where w.doc_id = d.doc_id) as n_lines,
  (select count(*) from gone g where g.doc_id = d.doc_id) as n_gone,
  coalesce((select string_agg(line_no::varchar, ',' order by line_no) from gone g where g.doc_id = d.doc_id), '') as gone
from documents d
"""
