"""Quality rules: base counts, and a hashed n-gram logistic model.

Features of a text are hashed counts of its words, word pairs, and character
3- and 4-grams in ``SLOTS`` slots, as square roots of shares.  A ridge logistic
regression is fitted on four fifths of a bounded sample of labelled rows
(``SAMPLE``, least hash of doc_id first), and a sigmoid calibrated on the rest.
Rows are scored in Arrow batches; a row is kept if the base rules pass and the
calibrated probability of good quality reaches ``KEEP_FROM``.

Edge cases: null text counts as empty (no words: base_failed); without labelled
rows of both classes only the base rules decide; repeated rows and null ids
get a result row each; empty tables give empty results; columns besides doc_id
and text are not looked at.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.llm.common import table

SAMPLE, SLOTS, KEEP_FROM = 3000, 4096, 0.5
#: The base rules' limits.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Distinct words that a task remembers (their numbers fit 21 bits).
REMEMBERED = 1 << 20
#: Characters whose n-grams are counted at once.
PART = 1 << 18


class Words(dict):
    """Word (bytes) -> its number; ``crc`` has a hash by number."""

    def __init__(self):
        super().__init__()
        self.crc = np.zeros(1 << 21, np.uint32)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        if number >= len(self.crc):
            self.crc = np.concatenate((self.crc, np.zeros_like(self.crc)))
        self.crc[number] = zlib.crc32(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(numbers) < 3:
        return 0
    _, dense = np.unique(numbers, return_inverse=True)
    if dense.max() >= 1 << 21:  # too many distinct words for one 63-bit key: number the pairs first
        _, pairs = np.unique(dense[:-1] * len(dense) + dense[1:], return_inverse=True)
        keys = pairs[:-1] * len(dense) + dense[2:]
    else:
        keys = (dense[:-2] << 42) | (dense[1:-1] << 21) | dense[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(numbers), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def base_counts(text: str, words: list[bytes], numbers: np.ndarray) -> list[int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    return [len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(numbers)]


def base_failed(counts: list[int]) -> bool:
    return counts[0] < LEAST_WORDS or 100 * counts[4] > 100 * MOST_REPEATED * counts[0]


def _slots(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


def ngram_shares(text: str, hashes: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed n-grams: characters (threes, fours) and words (ones, pairs)."""
    counts, codes, factor = np.zeros(SLOTS), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(0x01000193)
    for at in range(0, max(1, len(codes)), PART):
        c = codes[at : at + PART + 3]
        if len(c) >= 3:
            three = ((c[:-2] * factor ^ c[1:-1]) * factor) ^ c[2:]
            counts += np.bincount(_slots(three[:PART] ^ np.uint32(0x5BD1E995)), minlength=SLOTS)
            counts += np.bincount(_slots(three[:-1] * factor ^ c[3:]), minlength=SLOTS)
    if len(hashes):
        counts += np.bincount(_slots(hashes), minlength=SLOTS)
        counts += np.bincount(_slots(hashes[:-1] * np.uint32(31) ^ hashes[1:]), minlength=SLOTS)
    return np.sqrt(counts / max(1.0, counts.sum()))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, x: np.ndarray) -> float:
        if not len(self.weights):
            return 1.0
        z = self.slope * (x @ self.weights + self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated gradient steps on the ridge-penalised logistic loss."""
    n, d = x.shape
    w = v = np.zeros(d + 1)
    rate = 1 / (0.25 * (1 + 1) + ridge)  # rows have length 1, the bias adds 1
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v[:-1].astype(x.dtype) + v[-1], -30, 30)))
        grad = np.append((p - y).astype(x.dtype) @ x / n + ridge * v[:-1], (p - y).mean())
        nxt = v - rate * grad
        v = nxt + k / (k + 3) * (nxt - w)
        w = nxt
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    # One label and one text for each id (the least), so that repeated rows do not enlarge the sample.
    chosen = rows.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    texts = texts.select("text", "y", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held"))

    def shares(batches):
        words = Words()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode("utf-8", "replace")
                out.append(ngram_shares(text or "", words.crc[words.numbers(raw.split())]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_pydict({"x": pa.array(out, pa.binary()), "y": batch.column("y"), "held": batch.column("held")})

    got = texts.mapInArrow(shares, "x binary, y int, held boolean").collect()  # ``sample`` rows of fixed length at most
    got.sort(key=lambda r: (bytes(r["x"]), r["y"]))
    y, held = np.array([r["y"] for r in got], float), np.array([r["held"] for r in got], bool)
    if not got or len(set(y[~held])) < 2:
        return Model()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(len(got), SLOTS)
    weights, bias = _fit(x[~held], y[~held], 1e-5)
    if len(set(y[held])) < 2:
        return Model(weights, bias)
    z = (x[held] @ weights + bias)[:, None]
    scale = max(1e-9, float(np.abs(z).max()))
    slope, offset = _fit(z / scale, y[held], 1e-4)
    return Model(weights, bias, float(slope[0]) / scale, offset)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, p_good of each row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches):
        numbers = Words()
        for batch in batches:
            counts, failed, good = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                raw = text.encode("utf-8", "replace")
                words = raw.split()
                n = numbers.numbers(words)
                counts.append(base_counts(text, words, n))
                failed.append(base_failed(counts[-1]))
                good.append(model.probability(ngram_shares(text, numbers.crc[n])))
            cols = np.array(counts, np.int64).reshape(-1, 5).T
            kept = [not f and g >= KEEP_FROM for f, g in zip(failed, good)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(good, pa.float64())], ["doc_id", *names, "base_failed", "kept", "p_good"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, p_good double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
