"""The pipeline's deterministic stages on a small table against plain Python."""

import re

import corpus_pipeline
import xxhash
from pyspark.sql import functions as F

from lumentrace.llm import common, curriculum, packing

from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near(a, b):
    """One word inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 8:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_lines(rows):
    places = [(d, i, WORD.findall(line.lower())) for d, text in rows for i, line in enumerate((text or "").split("\n")) if WORD.search(line)]
    gone = {(d, i) for k, (d, i, w) in enumerate(places) if any(w == v or near(w, v) for _, _, v in places[:k])}
    return {d: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in gone) for d, text in rows}


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_first(texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    kept, left = [], sorted(texts)
    while left:
        group, todo = set(), [left[0]]
        while todo:
            i = todo.pop()
            group.add(i)
            todo += [j for j in left if j not in group and j not in todo and (prints[i] ^ prints[j]).bit_count() <= 3]
        kept.append(left[0])
        left = [i for i in left if i not in group]
    return kept


def test_lines_copies_mix_and_packing(spark):
    whole = common.table(spark, DATA, "documents")
    docs = common.cut_lineage(whole.where("n_chars < 1500"))
    line = "a passage of more than eight plain words that many share"
    more = [(10_001, f"{line}\nfirst"), (10_002, f"{line} indeed\nsecond"), (10_003, f"{line.replace('plain', 'common')}\nthird"), (10_004, None), (10_005, ""), (10_006, "same text here"), (10_007, "same text here")]
    extra = spark.createDataFrame([(i, t, "en", "made-up", len(t or "")) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(extra.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema.fields]))
    rows = sorted((r.doc_id, r.text) for r in docs.where("text is not null").collect()) + [(10_004, None)]
    lines = common.cut_lineage(corpus_pipeline.dedup_lines(spark, docs, DATA))
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert texts == plain_lines(rows)
    kept = common.cut_lineage(corpus_pipeline.drop_near_duplicates(spark, lines, DATA))
    assert sorted(r.doc_id for r in kept.collect()) == plain_first(texts)
    mixed = common.cut_lineage(corpus_pipeline.mix_sources(spark, kept, DATA))
    # A document is there once for each lap that takes half its words or more.
    laps = {r.doc_id: sum(2 * x >= r["size"] for x in (r.lap0, r.lap1) if x > 0) for r in curriculum.schedule(kept).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in laps.items() if n} and max(got.values()) <= 2
    packed = corpus_pipeline.pack_sequences(spark, mixed, DATA).collect()
    sizes = sum(r.length for r in packing.pieces(mixed).collect())
    assert sum(r.length for r in packed) == sizes
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY
