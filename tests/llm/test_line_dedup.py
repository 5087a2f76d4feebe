"""Lines that go, against plain Python, by pairs and by variants; how often the texts are read."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumentrace.llm import line_dedup


def near(a: list[str], b: list[str]) -> bool:
    if min(len(a), len(b)) < line_dedup.EDIT_FROM or abs(len(a) - len(b)) > 1:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def going(rows: list[tuple[int, str]]) -> set[tuple[int, int]]:
    seen, gone = [], set()
    for doc_id, text in sorted(rows):
        for i, line in enumerate(text.split("\n")):
            if words := line.lower().split():
                if any(near(words, x) for x in seen):
                    gone.add((doc_id, i))
                seen.append(words)
    return gone


def lines_of(seed: int) -> list[tuple[int, str]]:
    """Lines of 6 to 20 words that share openings and closings by the dozen, many of them one or two edits apart."""
    draw = random.Random(seed)
    bases = [[draw.choice("abcdefgh") for _ in range(draw.randint(6, 20))] for _ in range(5)]
    lines = []
    for _ in range(160):
        words = list(draw.choice(bases))
        for _ in range(draw.randint(0, 3)):
            at, word = draw.randrange(len(words)), draw.choice(["x", "y", "z", "ü", "q"])
            words[at : at + draw.randint(0, 1)] = [word] if draw.random() < 0.8 else []
        lines.append(draw.choice([" ", " ", "  ", "\t"]).join(words))
    lines += ["", " \t", "\v"]
    draw.shuffle(lines)
    return [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(41)]


@pytest.mark.parametrize("few", [0, 2, 8, 1000])
def test_pairs_and_variants_find_the_same_lines(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rows = lines_of(few)
    found = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, i) for r in found for i in r["_gone"]} == going(rows)


def test_texts_are_read_twice(spark):
    rows = lines_of(7)
    reads = spark.sparkContext.accumulator(0)

    def counted(text):
        reads.add(1)
        return text

    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.udf(counted, StringType()).asNondeterministic()("text"))
    assert line_dedup.repeated_lines(docs).count() > 0
    assert 0 < reads.value <= 2 * len(rows)


def long_lines(seed: int, n_words: int) -> list[tuple[int, str]]:
    """Near copies of one long line, by one or two edits at any place or at one, and lines that share its first or last half."""
    draw = random.Random(seed)
    some = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    base, rows = some(n_words), []
    for i in range(120):
        words = list(base)
        if i % 4 == 1:
            words[n_words // 3] = some(1)[0]
        elif i % 4 == 2:
            half = n_words // 2
            words = words[:half] + some(half + 1) if i % 8 == 2 else some(half) + words[half:]
        else:
            for _ in range(1 + i % 2):
                at = draw.randrange(len(words))
                words[at : at + draw.randint(0, 1)] = some(draw.randint(0, 1))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("few, n_words", [(0, 33), (8, 97), (2, 250)])
def test_long_lines_of_large_groups(spark, monkeypatch, few, n_words):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rows = long_lines(few, n_words)
    found = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, i) for r in found for i in r["_gone"]} == going(rows)


def generated(spark, work) -> int:
    """Rows that Generate nodes made while ``work`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs, n = store.executionsList(), 0
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            for metric in (metrics.apply(k) for k in range(metrics.size())):
                if node.name() == "Generate" and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    n += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return n


def test_rows_of_large_groups_do_not_grow_with_the_lines(spark):
    made = []
    for n_words in (40, 320):
        docs = spark.createDataFrame(long_lines(1, n_words), "doc_id long, text string")
        made.append(generated(spark, lambda: line_dedup.repeated_lines(docs).collect()))
    assert 120 <= made[0] and made[1] < 2.5 * made[0], made
