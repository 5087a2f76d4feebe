"""Best-two-fit packing of token documents into fixed-length sequences.

1. Tokenise (Arrow batches): byte-level BPE ids, then the end id.  A text is
   first cut at the vocabulary's added tokens, which have ids of their own and
   are no part of the text around them.  What is between is cut at spaces and
   line ends, where the pre-tokeniser always cuts too (it has no token in which
   white space follows anything else), and each distinct chunk that a worker
   remembers is encoded once.
2. Documents over the capacity are cut into full pieces; a shorter piece, if
   any, comes first.
3. The piece lengths are counted.  The plan is made from that histogram alone
   (one count for each length up to the capacity): fill a sequence greedily
   with the longest piece that fits, then replace its smallest piece by the two
   unpacked pieces that fill the gap that this leaves most tightly; repeat each
   such pattern as long as all its pieces last.  The plan's size depends on the
   capacity, not on the input.
4. Each piece gets its rank among pieces of equal length by two-level prefix
   sums over slices of the input's partitions, so that no id or text that many
   rows share fills a slice, and finds its place in the plan by binary search.

Edge cases: null and empty texts are one end id; repeated rows and null doc_ids
are packed like others; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import cut_lineage, table

CAPACITY, END_ID = 2048, 0
#: The vocabulary of byte_bpe_50k.json as ranks: its ids are the same, but for the added tokens, which only the JSON has.
RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Slices, of a partition or more each, in which pieces of one length are ranked, at most.
SLICES = 4096
#: Encoded chunks that a worker remembers.
REMEMBERED = 400_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE, _OTHER = re.compile(r"\s"), re.compile(r"[^\S \n]")
#: White space that is no chunk by itself: up to its last character it is one token, and all of it where the text ends.
_RUNS = ["".join(x) for x in itertools.product(" \n", repeat=3)]
_LAST_RUNS = tuple("".join(x) for x in itertools.product(" \n", repeat=2))


class Encoder:
    """Texts -> their ids as little-endian 32-bit bytes.

    A chunk is what stands after a space, or a line end with what stands after it; a text's first chunk, which has neither,
    is known by a space before it, as others have none within.
    """

    def __init__(self, ranks_file: str, added: dict[str, int]):
        """``added``: the ids of tokens that are found in raw text, whatever stands around them."""
        self.added = {token: np.array([i], "<u4").tobytes() for token, i in added.items()}
        # Of tokens that begin at one place the longest is found, as by tokenizers.
        self.between = re.compile("(" + ("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)") + ")")
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for piece, i in ranks.items() if piece[:1] in (b" ", b"\n")]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), "<u4")

    def _learn(self, chunks: set[str]) -> None:
        """Chunks with other white space within are left out."""
        self.known |= {c: self._ids(c or " ").tobytes() for c in chunks & {"", "\n"}}
        new = list(chunks.difference(self.known))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            if _OTHER.search("".join(part)):
                part = [c for c in part if not _OTHER.search(c)]
            # Joined, they are cut where they were: only a chunk's first id starts with a space or a line end.
            ids = self._ids(f" {' '.join(part)}".replace(" \n", "\n") if part else "")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(part):
                raw, bounds = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                self.known.update(zip(part, map(raw.__getitem__, map(slice, bounds, bounds[1:]))))
            else:
                self.known.update((c, self._ids(c if c[0] == "\n" else f" {c}").tobytes()) for c in part)

    def _learn_first(self, chunks: set[str]) -> None:
        self.known |= {c: self._ids(c[1:]).tobytes() for c in chunks.difference(self.known) if not _SPACE.search(c[1:])}

    def _slowly(self, text: str) -> bytes:
        """Of texts with other white space or more of it: cut at single spaces between other characters only."""
        first, *others = _CUT.split(text)
        found = [self.known.get(f" {first}"), *map(self.known.get, others)]
        return b"".join(self._ids(f" {x}" if i else x).tobytes() if ids is None else ids for i, (x, ids) in enumerate(zip([first, *others], found)))

    def _plain(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        chunked = [t.replace("\n", " \n").split(" ") for t in texts]
        distinct = set().union(*chunked)
        self._learn(distinct)
        for chunks in chunked:
            chunks[0] = f" {chunks[0]}"
        self._learn_first({chunks[0] for chunks in chunked})
        spaced = not distinct.isdisjoint(("", "\n"))
        found = []
        for text, chunks in zip(texts, chunked):
            try:
                odd = spaced and (text.endswith(_LAST_RUNS) or any(x in text for x in _RUNS))
                found.append(self._slowly(text) if odd else b"".join(map(self.known.__getitem__, chunks)))
            except KeyError:
                found.append(self._slowly(text))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        # Every second part is an added token; a plain search spares most texts the pattern.
        parts = [self.between.split(t) if any(x in t for x in self.added) else [t] for t in texts]
        plain = iter(self._plain([x for p in parts for x in p[::2]]))
        return [next(plain) if len(p) == 1 else b"".join(self.added[x] if i % 2 else next(plain) for i, x in enumerate(p)) for p in parts]


@functools.lru_cache(maxsize=1)
def _encoder(ranks_file: str, added: tuple[tuple[str, int], ...]) -> Encoder:
    """A worker's encoder, kept for its next tasks."""
    return Encoder(ranks_file, dict(added))


def added_tokens() -> dict[str, int]:
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def _pieces(ranks_file: str, added: dict[str, int], capacity: int):
    end = np.array([END_ID], "<u4").tobytes()
    tokens = tuple(added.items())

    def cut(batches):
        encoder = _encoder(ranks_file, tokens)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows: list[tuple] = []
            step = 512
            for at in range(0, len(texts), step):
                for k, raw in enumerate(encoder.encode(texts[at : at + step]), at):
                    raw += end
                    n = len(raw) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    rows += [(k, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            cols = [*zip(*rows)] or [[]] * 5
            ids = batch.column("doc_id").take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, ranks_file: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the documents' pieces."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = _pieces(ranks_file or public_tokenizers.path(RANKS), added_tokens(), capacity)
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths, how often) that hold pieces of the given lengths and counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    lengths = np.arange(capacity + 1)

    def below(avail: np.ndarray) -> np.ndarray:
        """The longest available length up to each length; 0 if none."""
        return np.maximum.accumulate(np.where(avail > 0, lengths, 0))

    while left.any():
        longest = below(left)
        bin_, gap, taken = [], capacity, {}
        while gap and (size := int(longest[gap])):
            n = min(gap // size, int(left[size]) - taken.get(size, 0))
            if n <= 0:  # used up in this sequence: look below it
                size = next((s for s in range(min(gap, size - 1), 0, -1) if left[s] > taken.get(s, 0)), 0)
                if not size:
                    break
                n = min(gap // size, int(left[size]) - taken.get(size, 0))
            bin_ += [size] * n
            taken[size] = taken.get(size, 0) + n
            gap -= n * size
        while gap:
            small = bin_[-1]
            room = gap + small
            avail = left.copy()
            for size, n in taken.items():
                avail[size] -= n
            upto = below(avail)
            one = lengths[: room + 1][avail[: room + 1] > 0]
            if not len(one):
                break
            other = np.minimum(upto[room - one], one)
            alone = (other == one) & (avail[one] < 2)
            other[alone] = upto[np.maximum(one[alone] - 1, 0)]
            total = np.where(other > 0, one + other, 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            bin_.pop()
            taken[small] -= 1
            for size in (int(one[best]), int(other[best])):
                bin_.append(size)
                taken[size] = taken.get(size, 0) + 1
            bin_.sort(reverse=True)
            gap = room - int(total[best])
        times = min(int(left[s]) // n for s, n in taken.items() if n)
        for size, n in taken.items():
            left[size] -= n * times
        patterns.append((bin_, times))
    return patterns


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset added."""
    # Written down before it is ranked: places stay as they are when a task is run again.
    found = cut_lineage(found.withColumn("place", F.monotonically_increasing_id()))
    found = found.withColumn("slice", F.pmod(F.shiftright("place", 33), F.lit(SLICES)).cast("int"))
    by_slice = found.groupBy("length", "slice").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_slice.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    slots, first = [], 0  # (length, first rank, first sequence, offset)
    used: dict[int, int] = {}
    for bin_, times in plan(counts, capacity):
        offset = 0
        for size in bin_:
            slots.append((size, used.get(size, 0), first, offset))
            used[size] = used.get(size, 0) + times
            offset += size
        first += times
    slots.sort()
    keys, firsts, offsets = (np.array(x, np.int64) for x in ([s << 44 | r for s, r, _, _ in slots], [f for *_, f, _ in slots], [o for *_, o in slots]))
    upto = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.select("length", "slice", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "slice").orderBy("place"))
    ranked = found.withColumn("nth", inside).join(by_slice, ["length", "slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))

    def place(batches):
        for batch in batches:
            wanted = batch.column("length").to_numpy() << 44 | batch.column("rank").to_numpy()
            at = np.searchsorted(keys, wanted, "right") - 1
            places = [pa.array(firsts[at] + wanted - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *places], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
