"""Toxicity by compression distance with two zstandard dictionaries.

Training (labels of rows with ``crc32(doc_id) % 5 != 0`` only):

* Segments (words and word beginnings) are counted per class over the labelled
  documents.  The ordinary dictionary holds the commonest ordinary segments.
  The toxic dictionary holds the same, then the segments whose document
  frequency in toxic text exceeds the ordinary one with a log-likelihood ratio
  of at least ``LEAST_RATIO``.  The ordinary one is padded to the same length,
  so both give a window equal lengths unless it has toxic segments.
* A window is one word inside a fixed carrier that either dictionary holds; the
  carrier makes every frame have a match, so that a word's own gain shows.  Its
  distance is the ordinary minus the toxic compressed length.
* Two thresholds of the distance are calibrated on the same rows: the least
  ones beyond which toxic text has ``NEAR_TIMES`` and ``FAR_TIMES`` as many of
  its windows as ordinary text.  A logistic curve over a document's distances
  (largest, numbers and rates of windows beyond the thresholds) is fitted.

The labelled sample is bounded by ``SAMPLE`` rows (least hash of doc_id first);
everything else reads every row and whole texts.  Labels, lang, source and
doc_id are never inputs of a score.

Edge cases: null or empty text is a document without windows and still gets a
score; without labelled rows of both classes every score is 0; repeated rows
score alike; null doc_ids are scored (held_out false); an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumentrace.llm.common import cut_lineage, held, released, table

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 10_000
#: Segments kept of each kind, at most; documents a toxic one needs.
ORDINARY, TOXIC, LEAST_DOCS, LEAST_RATIO = 1800, 400, 3, 15.0
#: Windows of toxic text must be so many times as common as those of ordinary text beyond the two thresholds.
NEAR_TIMES, FAR_TIMES = 2.0, 5.0
CARRIER = b"0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Windows whose distance a task remembers.
REMEMBERED = 100_000
#: Segments that a task counts together.
SEGMENTS_AT_ONCE = 100_000
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()
    #: Bytes by which the toxic dictionary shortens a window that counts, and that counts twice.
    near: int = 1
    far: int = 2


class Distances(dict):
    """Word -> ordinary minus toxic compressed length of its window."""

    def __init__(self, model: Model):
        super().__init__()
        given = zstandard.ZstdCompressionParameters.from_level(
            3, min_match=5, strategy=zstandard.STRATEGY_DFAST, window_log=17, hash_log=14, chain_log=14,
            write_checksum=0, write_content_size=0, write_dict_id=0,
        )
        self.one, self.other = (self._compressor(x, given) for x in (model.ordinary, model.toxic))

    @staticmethod
    def _compressor(content: bytes, given):
        held = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=given)
        return zstandard.ZstdCompressor(compression_params=given, dict_data=held)

    def __missing__(self, word: str) -> int:
        # The compressor looks for no match in a window's last eight bytes: the carrier's second half stands there.
        window = CARRIER[:16] + f" {word} ".encode("utf-8", "replace") + CARRIER[16:]
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = len(self.one.compress(window)) - len(self.other.compress(window))
        return found


def features(text: str | None, distances: Distances, near: int, far: int) -> list[float]:
    words = LETTERS.findall((text or "").lower())
    d = np.fromiter(map(distances.__getitem__, words), np.int64, len(words))
    near, far = int((d >= near).sum()), int((d >= far).sum())
    n = max(1, len(words))
    return [1.0, min(8, int(d.max(initial=0))), math.log1p(near), math.log1p(far), math.log1p(1000 * near / n), math.log1p(1000 * far / n)]


def calibrated(histogram: dict[tuple[int, int], int]) -> tuple[int, int]:
    """(near, far): the least distances beyond which toxic windows are often enough; from counts by (label, distance)."""
    whole = [max(1, sum(n for (label, _), n in histogram.items() if label == y)) for y in (0, 1)]
    share = lambda y, t: sum(n for (label, d), n in histogram.items() if label == y and d >= t) / whole[y]
    found = []
    for times in (NEAR_TIMES, FAR_TIMES):
        least = found[-1] + 1 if found else 1
        top = max((d for label, d in histogram if label == 1), default=least)
        found.append(next((t for t in range(least, top + 1) if share(1, t) > times * share(0, t)), max(least, top)))
    return found[0], found[1]


def _segments(text: str | None) -> set[str]:
    out = set()
    for word in set(LETTERS.findall((text or "").lower())):
        if 4 <= len(word) <= 40:
            out.add(f" {word} ")
            out.update(f" {word[:k]}" for k in range(4, min(len(word), 10)))
    return out


def _segment_rows(batches):
    seen: dict[tuple[str, int], int] = {}

    def counted():
        return pa.RecordBatch.from_pydict({"segment": pa.array([k[0] for k in seen], pa.string()), "toxic": pa.array([k[1] for k in seen], pa.int64()), "n": pa.array(seen.values(), pa.int64())})

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for x in _segments(text):
                seen[x, toxic] = seen.get((x, toxic), 0) + 1
            if len(seen) > SEGMENTS_AT_ONCE:
                yield counted()
                seen.clear()
    yield counted()


def _ratio(k: int, n: int, m: int, of: int) -> float:
    """Signed log-likelihood ratio of k of n against m of ``of``."""
    if k * of <= m * n:
        return 0.0
    part = lambda x, y, p: (x * math.log(p) if x else 0.0) + ((y - x) * math.log(1 - p) if y > x else 0.0)
    p = (k + m) / (n + of)
    return 2 * (part(k, n, k / n) + part(m, of, m / of) - part(k, n, p) - part(m, of, p))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton steps on the ridge-penalised logistic loss."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = labels.select("doc_id", F.col("toxic").cast("long").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    # One label and one text for each id (the least), so that repeated rows do not enlarge the sample.
    chosen = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    texts = cut_lineage(texts.select("text", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n, of = sizes.get(1, 0), sizes.get(0, 0)
    if not n or not of:
        return Model()
    counted = texts.mapInArrow(_segment_rows, "segment string, toxic long, n long").groupBy("segment").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("m"))
    counted = counted.where(f"k >= {LEAST_DOCS} or m >= {LEAST_DOCS}")
    common = [r["segment"] for r in counted.orderBy(F.desc("m"), "segment").limit(ORDINARY).collect()]
    p, q, both = F.col("k") / n, F.col("m") / of, (F.col("k") + F.col("m")) / (n + of)
    # An upper bound of the ratio (its toxic term) ranks; the exact one decides on the driver, over a bounded list.
    bound = counted.where((F.col("k") >= LEAST_DOCS) & (p > q)).orderBy(F.desc(F.col("k") * F.log(p / both) + F.when(F.col("m") > 0, F.col("m") * F.log(q / both)).otherwise(0)), "segment")
    # Of segments with one ratio the longest goes first: it shortens a window most.
    rated = sorted((-_ratio(r["k"], n, r["m"], of), -len(r["segment"]), r["segment"]) for r in bound.limit(10 * TOXIC).collect())
    chosen_segments: list[str] = []
    for ratio, _, segment in rated:
        if -ratio < LEAST_RATIO or len(chosen_segments) == TOXIC:
            break
        if not any(x in segment or segment in x for x in chosen_segments):
            chosen_segments.append(segment)
    base = " ".join(common[::-1]).encode()
    tail = "\x01".join(chosen_segments[::-1]).encode()
    model = Model(base + b"\0" * len(tail), base + tail)

    def histogram(batches):
        distances, counts = Distances(model), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts.update((label, distances[w]) for w in LETTERS.findall((text or "").lower()))
        yield pa.RecordBatch.from_pydict({"label": pa.array([k for k, _ in counts], pa.int64()), "d": pa.array([d for _, d in counts], pa.int64()), "n": pa.array(counts.values(), pa.int64())})

    seen = texts.mapInArrow(histogram, "label long, d long, n long").groupBy("label", "d").agg(F.sum("n").alias("n")).collect()  # a row a distance
    near, far = calibrated({(r["label"], r["d"]): r["n"] for r in seen})

    def rows_of(batches):
        distances = Distances(model)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([features(t, distances, near, far) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())), "y": batch.column("toxic").cast(pa.float64())})

    got = sorted((r["y"], r["x"]) for r in texts.mapInArrow(rows_of, "x array<double>, y double").collect())  # at most ``sample`` rows of six numbers
    return Model(model.ordinary, model.toxic, _logistic(np.array([x for _, x in got]), np.array([y for y, _ in got])), near, far)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of the columns of ``docs``) and score (0 to 1)."""
    rows = held(docs)
    at = docs.columns.index("text")

    def score(batches):
        distances = Distances(model) if model.weights else None
        for batch in batches:
            texts = batch.column("row").field(at).to_pylist()
            if distances is None:
                s = np.zeros(len(texts))
            else:
                s = 1 / (1 + np.exp(-np.clip([float(np.dot(model.weights, features(t, distances, model.near, model.far))) for t in texts], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.asarray(s, np.float64))], ["row", "score"])

    return rows.mapInArrow(score, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``."""
    return released(scored(docs, train(docs, labels)).where(F.col("score") < threshold))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
