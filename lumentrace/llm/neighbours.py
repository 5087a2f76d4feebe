"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` rows, least hash first, and
``SAMPLE_BYTES``): k-means cuts the sample into ``BRANCHES`` parts, each part
again, down to leaves of ``LEAF`` sampled rows.  Every vector of the table goes
down the tree to its leaf.

A query visits leaves best bin first: a priority queue holds tree nodes by
their centre's distance, the nearest node is taken, a leaf is visited, another
node's children are queued.  How many leaves are visited is calibrated:
``CALIBRATION`` further rows are compared with all rows, and visits widen, leaf by
leaf, until the mean share of their true neighbours in the leaves visited so
far reaches ``RECALL``.  A query that has met too few rows by
then goes on to further leaves.

Equal vectors are searched as one, with the least ids that a result can hold,
so a third of all rows being copies costs no more than one row.  Leaves, in the
tree's order, fill bins of bounded bytes (a leaf greater than that is split by
hash); queries are dealt by the bin of their first leaf, as many as a task may hold,
and go to a bin once, with the leaves that they visit there.  Distances of survivors of a matrix product
are computed anew from the vectors' differences.

Edge cases: vectors that are null, empty or zero or hold null or non-finite
components, and rows without vec_id, take no part; vectors of different lengths
never meet, each length has its own tree; rows that share a vec_id are queries
each, and each a candidate for all but itself; ties go to the smaller vec_id;
an empty table gives an empty result; columns besides vec_id and embedding are
not looked at.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import cut_lineage, table

TOP, QUERY_EVERY = 10, 100
SAMPLE, SAMPLE_BYTES, BRANCHES, LEAF, ROUNDS = 16384, 1 << 26, 8, 32, 8
CALIBRATION, RECALL = 256, 0.97
#: Bytes of vectors that a task holds of a bin, and of queries; smaller tables make ``BINS`` bins, of ``LEAST_BIN`` vectors at least.
BIN_BYTES, BINS, LEAST_BIN = 1 << 25, 64, 512
#: Queries that are scored together.
TILE = 256
FOUND = "query long, query_id long, vec_id long, score double"


def sound_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (floats or doubles, as given), dim."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    # Adding zero makes -0.0 the same as 0.0.
    return kept.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind)).alias("v"), F.size("embedding").alias("dim"))


def distinct_vectors(vectors: DataFrame, k: int = TOP) -> DataFrame:
    """number, dim, v, ids: each vector once, with the k + 1 least ids of its rows, written down."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = vectors.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    each = least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    return cut_lineage(each.select(F.monotonically_increasing_id().alias("number"), F.size("v").alias("dim"), "v", "ids"))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of an array column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product, good to rounding."""
    return np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows to rows, from their differences."""
    d = a - b
    return np.sqrt((d * d).sum(axis=-1))


@dataclass
class Tree:
    """Nodes in depth-first order: centres, children (numbers of nodes) and leaf numbers (-1 inside)."""

    centres: np.ndarray
    children: list[np.ndarray] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def n_leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector goes down to, by the nearest child at each node."""
        out, stack = np.zeros(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                nearest = _squares(vectors[rows], self.centres[self.children[node]]).argmin(axis=1)
                stack += [(int(c), rows[nearest == k]) for k, c in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, least_leaves: int, sizes: np.ndarray, least_rows: int) -> list[int]:
        """Leaves best bin first: ``least_leaves``, and more until they hold ``least_rows``."""
        near = ((self.centres - query) ** 2).sum(axis=1)
        queue, out, met = [(0.0, 0)], [], 0
        while queue and (len(out) < least_leaves or met < least_rows):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                met += int(sizes[self.leaf[node]])
            else:
                for c in self.children[node]:
                    heapq.heappush(queue, (float(near[c]), int(c)))
        return out


def _means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Which of up to k means each row is nearest to; empty ones go."""
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(ROUNDS):
        near = _squares(rows, centres).argmin(axis=1)
        present, near = np.unique(near, return_inverse=True)
        centres = np.zeros((len(present), rows.shape[1]))
        np.add.at(centres, near, rows)
        centres /= np.bincount(near)[:, None]
    return near


def grow(sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 0) -> Tree:
    rng = np.random.default_rng(seed)
    centres, tree = [], Tree(np.zeros((0, sample.shape[1])))

    def add(rows: np.ndarray) -> int:
        number = len(centres)
        centres.append(rows.mean(axis=0) if len(rows) else np.zeros(sample.shape[1]))
        tree.children.append(np.zeros(0, int))
        tree.leaf.append(-1)
        part = _means(rows, branches, rng) if len(rows) > max(leaf, branches) else np.zeros(0, int)
        if len(np.unique(part)) > 1:
            tree.children[number] = np.array([add(rows[part == p]) for p in range(part.max() + 1)])
        else:
            tree.leaf[number] = sum(x >= 0 for x in tree.leaf)
        return number

    add(sample)
    tree.centres = np.array(centres)
    return tree


def _nearest(query, score, ids, k: int):
    """Row numbers of the k nearest of each query: by score, then smaller id."""
    order = np.lexsort((ids, score, query))
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])[: len(q)]
    nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[nth < k]


def search(queries: np.ndarray, q_ids: np.ndarray, allowed, vectors: np.ndarray, lists: list, k: int):
    """(query index, vec_id, score) of the k nearest rows of each query among the vectors that ``allowed(tile)`` marks.

    ``lists`` holds the ids of each vector's rows; an equal vector's list holds the query's own row, which does not count.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(queries), TILE):
        q = queries[at : at + TILE]
        near = np.where(allowed(slice(at, at + TILE)), _squares(q, vectors), np.inf)
        # The k + 1 vectors nearest by the product, and whatever rounding could put among them.
        kth = np.partition(near, k, axis=1)[:, k] if near.shape[1] > k + 1 else np.full(len(q), np.inf)
        slack = 1e-9 * ((q * q).sum(axis=1) + (vectors * vectors).sum(axis=1).max(initial=0.0))
        a, b = np.nonzero((near <= (kth + slack)[:, None]) & np.isfinite(near))
        score = distances(q[a], vectors[b])
        sizes = np.fromiter((len(lists[j]) for j in b), np.int64, len(b))
        ids = np.array([i for j in b for i in lists[j]], np.int64)
        pair = np.repeat(np.arange(len(b)), sizes)
        query, score = a[pair], score[pair]
        own = (score == 0) & (ids == q_ids[at : at + TILE][query])
        # One row of a query's own id at its own place is itself.
        first = np.zeros(len(own), bool)
        if own.any():
            first[np.flatnonzero(own)[np.unique(query[own], return_index=True)[1]]] = True
        query, ids, score = query[~first], ids[~first], score[~first]
        best = _nearest(query, score, ids, k)
        out.append((at + query[best], ids[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def exact_leaves(vectors: DataFrame, asked: np.ndarray, k: int) -> list[np.ndarray]:
    """Leaves of the k vectors nearest to each of the few ``asked`` ones, themselves left out, among all of ``vectors`` (v, number, leaf)."""
    lengths = (asked * asked).sum(axis=1)

    def nearest(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            v, number, leaf = _matrix(batch.column("v"), asked.shape[1]), batch.column("number").to_numpy(), batch.column("leaf").to_numpy()
            near = _squares(asked, v)
            a, b = np.nonzero(near > 1e-12 * lengths[:, None])
            found = [a, number[b], near[a, b], leaf[b]]
            held = found if held is None else [np.concatenate(x) for x in zip(held, found)]
            best = _nearest(held[0], held[2], held[1], k)
            held = [x[best] for x in held]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["asked", "number", "score", "leaf"])

    found = vectors.select("v", "number", "leaf").mapInArrow(nearest, "asked long, number long, score double, leaf long")
    nth = F.row_number().over(Window.partitionBy("asked").orderBy("score", "number"))
    rows = found.withColumn("nth", nth).where(F.col("nth") <= k).select("asked", "leaf").collect()  # k for each of CALIBRATION rows
    out = [[] for _ in asked]
    for r in rows:
        out[r["asked"]].append(r["leaf"])
    return [np.array(x, np.int64) for x in out]


def calibrated(tree: Tree, asked: np.ndarray, wanted: list[np.ndarray], recall: float = RECALL) -> tuple[int, float]:
    """(visits, recall): the fewest leaves visited best bin first that hold ``recall`` of the wanted ones."""
    places, none = [], np.ones(tree.n_leaves)
    for q, leaves in zip(asked, wanted):
        place = np.empty(tree.n_leaves, int)
        place[tree.visits(q, tree.n_leaves, none, 0)] = np.arange(tree.n_leaves)
        places.append(place[leaves])
    places = np.concatenate([np.zeros(0, int), *places])
    for visits in range(1, tree.n_leaves + 1):
        share = float((places < visits).mean()) if len(places) else 1.0
        if share >= recall:
            return visits, share
    return tree.n_leaves, 1.0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of ``queries``, rows of ``sound_vectors`` like ``vectors``."""
    held = distinct_vectors(vectors, k)
    queries = cut_lineage(queries.withColumn("query", F.monotonically_increasing_id()))
    parts = [_nearest_of(held.where(F.col("dim") == d), queries.where(F.col("dim") == d), d, k, recall) for d in sorted(r["dim"] for r in queries.select("dim").distinct().collect())]
    out = held.sparkSession.createDataFrame([], FOUND)
    for p in parts:
        out = out.unionByName(p)
    nth = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return out.withColumn("rank", nth.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_of(held: DataFrame, queries: DataFrame, dim: int, k: int, recall: float) -> DataFrame:
    context, kind = held.sparkSession.sparkContext, held.schema["v"].dataType.simpleString()
    most = max(2 * BRANCHES, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    rows = held.orderBy(F.xxhash64("v"), "number").limit(most + CALIBRATION).select("v").toArrow()  # SAMPLE and CALIBRATION rows, SAMPLE_BYTES at most
    sample = _matrix(rows["v"], dim)
    # Rows that the tree has not seen, where there are enough.
    asked, sample = sample[-CALIBRATION:], sample[: -CALIBRATION if len(sample) > 2 * CALIBRATION else None]
    tree = grow(sample)
    shared = context.broadcast(tree)  # 2 * SAMPLE centres at most

    def placed(batches):
        for batch in batches:
            leaf = shared.value.leaf_of(_matrix(batch.column("v"), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    found = cut_lineage(held.select("number", "v", "ids").mapInArrow(placed, f"number long, v {kind}, ids array<long>, leaf long"))
    counts = found.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows")).collect()  # a row for each leaf
    n, n_rows = np.zeros(tree.n_leaves, np.int64), np.zeros(tree.n_leaves, np.int64)
    for r in counts:
        n[r["leaf"]], n_rows[r["leaf"]] = r["n"], r["rows"]
    visits, _ = calibrated(tree, asked, exact_leaves(found, asked, k), recall)

    # Leaves fill bins in the tree's order; one beyond a bin's size has bins of its own.
    most = max(1, BIN_BYTES // (8 * dim))
    size = min(most, max(LEAST_BIN, math.ceil(int(n.sum()) / BINS)))
    first, parts, bins, filled = np.zeros(tree.n_leaves, np.int64), np.ones(tree.n_leaves, np.int64), 0, 0
    for leaf in range(tree.n_leaves):
        if filled and filled + n[leaf] > size:
            bins, filled = bins + 1, 0
        first[leaf], parts[leaf] = bins, max(1, math.ceil(n[leaf] / size))
        filled += n[leaf]
        if parts[leaf] > 1:
            bins, filled = bins + parts[leaf], 0
    places = context.broadcast((first, parts, n_rows))
    of = lambda a: F.get(F.array(*[F.lit(int(x)) for x in a]), F.col("leaf").cast("int"))
    found = found.withColumn("bin", of(first) + F.pmod(F.xxhash64("number"), of(parts)))

    def dealt(batches):
        """A row for each bin that a query visits, with its leaves there."""
        tree, (first, parts, sizes) = shared.value, places.value
        for batch in batches:
            out = []
            for i, q in enumerate(_matrix(batch.column("v"), dim) if batch.num_rows else []):
                by_bin = {}
                leaves = tree.visits(q, visits, sizes, k + 1)
                for leaf in leaves:
                    for b in range(first[leaf], first[leaf] + parts[leaf]):
                        by_bin.setdefault(int(b), []).append(leaf)
                home = int(first[leaves[0]])
                out += [(i, home, b, x) for b, x in by_bin.items()]
            at = pa.array([x[0] for x in out], pa.int64())
            columns = [batch.column(c).take(at) for c in ("query", "vec_id", "v")]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x[j] for x in out], pa.int64()) for j in (1, 2)], pa.array([x[3] for x in out], pa.list_(pa.int64()))], names=["query", "vec_id", "v", "home", "bin", "leaves"])

    each = cut_lineage(queries.select("query", "vec_id", "v").mapInArrow(dealt, f"query long, vec_id long, v {kind}, home long, bin long, leaves array<long>"))
    # Queries of neighbouring home bins go together, as many as a task may hold.
    n_queries = {r["home"]: r["n"] for r in each.where("home = bin").groupBy("home").agg(F.count("*").alias("n")).collect()}  # a row for each bin
    groups, group, filled = [], 0, 0
    for home, count in sorted(n_queries.items()):
        if filled and filled + count > most:
            group, filled = group + 1, 0
        groups.append((home, group, max(1, math.ceil(count / most))))
        filled += count
    groups = held.sparkSession.createDataFrame(groups, "home long, group long, chunks long")
    each = each.join(F.broadcast(groups), "home").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks"))).drop("home", "chunks")
    keys = ["group", "chunk", "bin"]

    def scored(key, asked: pa.Table, vectors: pa.Table) -> pa.Table:
        if not asked.num_rows or not vectors.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        leaf = vectors["leaf"].to_numpy()
        visited = np.zeros((asked.num_rows, tree.n_leaves), bool)
        for i, leaves in enumerate(asked["leaves"].to_pylist()):
            visited[i, leaves] = True
        q, ids, score = search(_matrix(asked["v"], dim), asked["vec_id"].to_numpy(), lambda tile: visited[tile][:, leaf], _matrix(vectors["v"], dim), vectors["ids"].to_pylist(), k)
        return pa.table({"query": asked["query"].to_numpy()[q], "query_id": asked["vec_id"].to_numpy()[q], "vec_id": ids, "score": score})

    wanted = each.select(*[F.col(c).alias(c) for c in keys]).distinct()
    sent = found.join(wanted, "bin").select(*[F.col(c).alias(c) for c in (*keys, "v", "ids", "leaf")])
    return each.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(scored, FOUND)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = sound_vectors(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
