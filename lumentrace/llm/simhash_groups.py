"""SimHash near-duplicate groups through a Gray-ordered hierarchical index.

Fingerprints: 64-bit SimHash over 3-word shingles (XXH64, seed 42).  Two
documents link when their fingerprints differ in at most ``RADIUS`` bits, and a
group is a connected component of links.

How the index is spread over a cluster:

* Equal fingerprints are folded first, so copies never form pairs.
* Four rotations of each fingerprint bring one 16-bit block to the front.  With
  at most three differing bits one block is equal, and because the Gray rank's
  leading bits depend on the leading bits alone, sorting a rotation by Gray
  rank puts all partners of that block side by side (one run = one sub-index).
* A run longer than ``LONG_RUN`` is split again by the same argument on its 48
  remaining bits (four blocks of 12), so hot runs spread over many tasks.
* Inside a run, consecutive fingerprints of the Gray order form nodes; a node
  keeps the bits that all its members share (mask and pattern).  Pairs of nodes
  are pruned as soon as the differences on the shared bits exceed the radius,
  and only surviving leaves compare members.  A run yields a spanning forest,
  never its pairs.
* Components: alternating large-star / small-star rounds, checkpointed.

Edge cases: null text counts as empty; a text without words has fingerprint
zero and links like any other; fewer than three words form one shingle; a null
doc_id takes part, and a group whose ids are all null has a null component_id;
repeated rows get a result row each; an empty table gives an empty result.
Only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import cut_lineage, held, released, table

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints with an equal block up to which one sub-index serves them.
LONG_RUN = 4096
#: Members of a leaf node, children of an upper node.
LEAF, FANOUT = 16, 8
#: Node or member pairs that are looked at together: bounds a task's memory.
PAIRS_AT_ONCE = 1 << 18


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist())),
        np.uint64,
        len(starts),
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
        kept = batch.drop_columns(["_text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(prints)], [*kept.schema.names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _key (hash of id and text, names a row's content), fp."""
    kept = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), F.col("text").alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(_fingerprints, f"doc_id {kind}, _key long, fp long")


def _rotated(fp, bits: int):
    return fp if not bits else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def _gray_rank(x):
    """Position of a code word in the reflected Gray order."""
    for step in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, step))
    return x


def _runs(prints: DataFrame, long_run: int) -> DataFrame:
    """run (long), rank (orders as the unsigned Gray rank), fp."""
    blocks = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), _rotated(F.col("fp"), 16 * i).alias("code")) for i in range(4)])).alias("b"),
    ).select("fp", "b.turn", "b.code")
    blocks = blocks.withColumn("head", F.shiftrightunsigned("code", 48) + F.col("turn") * F.lit(1 << 16))
    # At most 4 * 65,536 heads exist, whatever the input.
    hot = blocks.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > long_run).select("head", F.lit(True).alias("hot"))
    blocks = blocks.join(F.broadcast(hot), "head", "left")
    tail = lambda i: F.shiftrightunsigned("code", 36 - 12 * i).bitwiseAND(F.lit(0xFFF))
    second = F.array(*[(F.lit(1 + i) * F.lit(1 << 40) + F.col("head") * F.lit(1 << 12) + tail(i)) for i in range(4)])
    return blocks.select(
        F.explode(F.when(F.col("hot"), second).otherwise(F.array("head"))).alias("run"),
        _gray_rank(F.col("code")).bitwiseXOR(F.lit(-(1 << 63))).alias("rank"),
        "fp",
    )


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked members the least label of their component, in place."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        # Roots only are hooked: a link whose root went elsewhere stays open, and no member leaves its component.
        np.minimum.at(label, high, low)
        while not np.array_equal(nxt := label[label], label):
            label[:] = nxt


def _expand(i: np.ndarray, j: np.ndarray, fan: int, n_below: int) -> tuple[np.ndarray, np.ndarray]:
    """Children pairs (left <= right) of node pairs."""
    left = (i[:, None] * fan + np.arange(fan))[:, :, None]
    right = (j[:, None] * fan + np.arange(fan))[:, None, :]
    left, right = np.broadcast_arrays(left, right)
    left, right = left.ravel(), right.ravel()
    keep = (left <= right) & (right < n_below)
    return left[keep], right[keep]


def forest(codes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Component labels (index of a member) of fingerprints in Gray order."""
    label = np.arange(len(codes))
    if len(codes) < 2:
        return label
    for gap in (1, 2):  # neighbours in Gray order link most of a dense group
        near = np.flatnonzero(np.bitwise_count(codes[gap:] ^ codes[:-gap]) <= radius)
        _union(label, near, near + gap)
    shared_and, shared_or, sizes = [codes], [codes], [1]
    for fan in (LEAF, *[FANOUT] * 20):
        if len(shared_and[-1]) == 1:
            break
        cuts = np.arange(0, len(shared_and[-1]), fan)
        shared_and.append(np.bitwise_and.reduceat(shared_and[-1], cuts))
        shared_or.append(np.bitwise_or.reduceat(shared_or[-1], cuts))
        sizes.append(sizes[-1] * fan)

    def joined(level: int) -> np.ndarray:
        """The one component that all members of a node are in, or -1."""
        cuts = np.arange(0, len(codes), sizes[level])
        low, high = np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts)
        return np.where(low == high, low, -1)

    def descend(level: int, i: np.ndarray, j: np.ndarray) -> None:
        if level == 0:
            off = i != j
            i, j = i[off], j[off]
            linked = np.bitwise_count(codes[i] ^ codes[j]) <= radius
            _union(label, i[linked], j[linked])
            return
        mask = ~(shared_and[level] ^ shared_or[level])
        differ = np.bitwise_count((shared_and[level][i] ^ shared_and[level][j]) & mask[i] & mask[j])
        one = joined(level)
        keep = (differ <= radius) & ~((one[i] == one[j]) & (one[i] >= 0))
        i, j = i[keep], j[keep]
        fan = LEAF if level == 1 else FANOUT
        step = max(1, PAIRS_AT_ONCE // (fan * fan))
        for at in range(0, len(i), step):
            descend(level - 1, *_expand(i[at : at + step], j[at : at + step], fan, len(shared_and[level - 1])))

    descend(len(shared_and) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))
    return label


def _links(batches):
    """A spanning forest (a, b) of each run; rows arrive sorted by run and rank."""

    def solve(run: np.ndarray, fp: np.ndarray):
        codes = fp.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        lengths = np.diff(np.r_[starts, len(run)])
        a, b = [], []
        small = np.repeat(lengths <= 2 * LEAF, lengths)
        for gap in range(1, min(2 * LEAF, int(lengths.max(initial=1)))):
            at = np.flatnonzero(small[gap:] & (run[gap:] == run[:-gap]))
            at = at[np.bitwise_count(codes[at] ^ codes[at + gap]) <= RADIUS]
            a.append(at)
            b.append(at + gap)
        for s, n in zip(starts[lengths > 2 * LEAF], lengths[lengths > 2 * LEAF]):
            label = forest(codes[s : s + n])
            child = np.flatnonzero(label != np.arange(n))
            a.append(s + child)
            b.append(s + label[child])
        if a and len(i := np.concatenate(a)):
            yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[np.concatenate(b)])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        run, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "fp"))
        held.append((run, fp))
        size += len(run)
        if size < 1 << 16 or run[0] == run[-1]:
            continue
        run, fp = (np.concatenate(x) for x in zip(*held))
        cut = int(np.flatnonzero(run != run[-1])[-1]) + 1
        yield from solve(run[:cut], fp[:cut])
        held, size = [(run[cut:], fp[cut:])], len(run) - cut
    if held:
        yield from solve(*(np.concatenate(x) for x in zip(*held)))


def links(prints: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every component."""
    runs = _runs(prints, long_run).repartition("run").sortWithinPartitions("run", "rank").select("run", "fp")
    return runs.mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for the nodes of ``edges``.

    Alternates large-star and small-star rounds until nothing changes.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        edges = cut_lineage(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        seen = tuple(state)


def grouped(docs: DataFrame, long_run: int = LONG_RUN) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, _key, fp), (per fp: fp, root, least struct(no_id, doc_id, _key))."""
    rows = cut_lineage(fingerprints(docs))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key"))
    prints = cut_lineage(rows.groupBy("fp").agg(least.alias("first")))
    found = components(links(prints.select("fp"), long_run))
    owned = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = owned.groupBy("root").agg(F.min("first").alias("first"))
    return rows, owned.select("fp", "root").join(first, "root")


def near_duplicate_groups(docs: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row of ``docs``."""
    rows, groups = grouped(docs, long_run)
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id.

    Ties (repeated ids) fall to the smallest content hash, repeated rows to one
    of them; all columns stay.
    """
    _, groups = grouped(docs, long_run)
    first = groups.select("root", "first").distinct().select(F.col("first._key").alias("_key"))
    once = Window.partitionBy("_key").orderBy("row.doc_id")
    keyed = held(docs, _key=F.xxhash64("doc_id", "text")).join(first.distinct(), "_key", "left_semi")
    return released(keyed.withColumn("nth", F.row_number().over(once)).where("nth = 1"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
