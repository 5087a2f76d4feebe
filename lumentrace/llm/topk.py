"""Exact top-k inner products, pruned by length and by rotated partial sums.

Vectors become integers, floor(256 * x).  Candidates are cut into blocks by
descending length, queries into chunks; a task sees one chunk and one block.

* Round 1 scores every chunk against the block of the longest vectors; its k-th
  scores are lower bounds.  Round 2 sends a query to another block only if
  |q| times the block's greatest length can still reach its bound.
* In a task, candidates go by descending length in tiles.  A query is done when
  |q| times the tile's first length is below its k-th score.  For the others
  the vectors are rotated by a singular basis of the block: the leading
  coordinates' partial sum plus the Cauchy-Schwarz bound of the rest discards
  pairs; what survives is scored exactly.

Scores are sums of integer products, exact in doubles below 2^53 (checked;
beyond, Python's integers).  A score beyond a long is held at a long's bound,
and ties there.  Bounds are widened by a relative margin, so that rounding
prunes nothing that belongs to the result.

Edge cases: vectors that are null or hold null or non-finite components, and
rows without vec_id, take no part; vectors of different lengths never meet;
rows that share a vec_id are queries each, and each a candidate for all but
itself; ties go to the smaller vec_id; an empty table gives an empty result;
columns besides vec_id and embedding are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import cut_lineage, table

TOP, SCALE, QUERY_EVERY = 5, 256, 50
#: Least rows of a block and of a chunk; both grow with the root of the table.
BLOCK, CHUNK = 8192, 4096
#: Candidates that are scored together; rotated coordinates of the partial sums.
TILE, LEADING = 1024, 24
#: Rows of a block, about, that its singular basis is taken from; all rows are scored with it.
BASIS_ROWS = 1024
MARGIN = 1e-9
FOUND = "query long, query_id long, vec_id long, score long"


def _floor(x):
    """Floor as a double; doubles of 2^52 or more are whole, and beyond a long's range."""
    return F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (integers as doubles), dim, length."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(SCALE * x.cast("double")) < F.lit(float("inf"))))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    kept = kept.select("vec_id", F.transform("embedding", lambda x: _floor(SCALE * x.cast("double"))).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return kept.select("vec_id", "v", F.size("v").alias("dim"), length.alias("length"))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of an array column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def basis_of(vectors: np.ndarray) -> np.ndarray:
    """Up to ``LEADING`` orthonormal columns: the leading right singular vectors of evenly spaced rows."""
    rows = vectors[:: max(1, len(vectors) // BASIS_ROWS)][: 2 * BASIS_ROWS]
    return np.linalg.svd(rows / max(1.0, float(np.abs(rows).max(initial=0))), full_matrices=False)[2][:LEADING].T


def _best(query, ids, score, k: int):
    """The k best of each query: by score, then smaller id."""
    order = np.lexsort((ids, ~score, query))
    query, ids, score = query[order], ids[order], score[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    nth = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = nth < k
    return query[keep], ids[keep], score[keep]


def search_block(q_rows, q, least, c_rows, c_ids, c, k: int = TOP):
    """(query index, candidate id, score) of each query's k best in a block that is sorted by descending length."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**53
    ql, cl = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    basis = basis_of(c)
    qr, cr = q @ basis, c @ basis
    # What the leading coordinates leave of a vector; the two rests' lengths bound their product.
    q_rest, c_rest = np.linalg.norm(q - qr @ basis.T, axis=1), np.linalg.norm(c - cr @ basis.T, axis=1)

    def products(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if exact:
            return np.einsum("ij,ij->i", q[i], c[j]).astype(np.int64)
        found = (sum(int(x) * int(y) for x, y in zip(q[a].tolist(), c[b].tolist())) for a, b in zip(i, j))
        return np.array([max(-(2**63), min(2**63 - 1, x)) for x in found], np.int64)

    bound = least.astype(float).copy()
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    active = np.arange(len(q))
    at, step = 0, 64
    while at < len(c) and len(active):
        end = min(len(c), at + step)
        slack = MARGIN * (ql * cl[at] + 1)
        active = active[~(ql[active] * cl[at] + slack[active] < bound[active])]  # not a number: unbounded
        partial = qr[active] @ cr[at:end].T + q_rest[active][:, None] * c_rest[at:end]
        a, b = np.nonzero(~(partial + slack[active][:, None] < bound[active][:, None]))
        if exact and len(a) * 4 > partial.size:
            score = (q[active] @ c[at:end].T)[a, b].astype(np.int64)
        else:
            score = np.concatenate([np.zeros(0, np.int64), *(products(active[a[i : i + 65536]], at + b[i : i + 65536]) for i in range(0, len(a), 65536))])
        a, b = active[a], at + b
        keep = (score >= bound[a]) & (c_rows[b] != q_rows[a])
        best = _best(*(np.concatenate(x) for x in zip(best, (a[keep], c_ids[b[keep]], score[keep]))), k)
        query, _, scores = best
        last = np.flatnonzero(np.r_[query[1:] != query[:-1], True]) if len(query) else np.zeros(0, np.int64)
        full = last[np.bincount(query, minlength=len(q))[query[last]] == k] if len(query) else last
        bound[query[full]] = np.maximum(bound[query[full]], scores[full])
        at, step = end, TILE
    return best


def _searcher(k: int):
    def search(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        dim = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q, c = _matrix(queries["v"], dim), _matrix(candidates["v"], dim)
        order = np.argsort(-candidates["length"].to_numpy(), kind="stable")
        q_rows, c_rows, c_ids = queries["row"].to_numpy(), candidates["row"].to_numpy()[order], candidates["vec_id"].to_numpy()[order]
        query, ids, score = search_block(q_rows, q, queries["least"].to_numpy(), c_rows, c_ids, c[order], k)
        return pa.table({"query": q_rows[query], "query_id": queries["vec_id"].to_numpy()[query], "vec_id": ids, "score": score})

    return search


def numbered(vectors: DataFrame) -> DataFrame:
    """``vectors``, written down, with ``row``, a number that tells rows of one id apart."""
    return cut_lineage(vectors.withColumn("row", F.monotonically_increasing_id()))


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = TOP, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs from one ``numbered`` table of ``whole_vectors``."""
    n, n_queries = vectors.count(), queries.count()
    grown = 16 * math.isqrt(n)
    n_blocks, n_chunks = max(1, math.ceil(n / max(block, grown))), max(1, math.ceil(n_queries / max(chunk, grown)))
    # Equal lengths spread over blocks by a slight hashed shift; bounds use a block's true greatest length.
    place = F.col("length") * (1 + 1e-9 * F.pmod(F.xxhash64("row"), F.lit(1 << 20)))
    cuts = vectors.agg(F.percentile_approx(place, [1 - i / n_blocks for i in range(1, n_blocks)], 100 * n_blocks)).first()[0] if n_blocks > 1 and n else []
    # Cuts fall: a row's block is the number of cuts above it, found by halving.
    blocks = F.lit(0) if not cuts else _above(place, list(cuts))
    candidates = vectors.withColumn("block", blocks.cast("int"))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(n_chunks)).cast("int"))
    keys, search = ["dim", "chunk", "block"], _searcher(k)

    def scored(asked: DataFrame, held: DataFrame) -> DataFrame:
        # A block goes only to the chunks that ask for it.
        wanted = asked.select(*[F.col(c).alias(c) for c in keys]).distinct()
        held = held.select(*[F.col(c).alias(c) for c in ("dim", "block", "row", "vec_id", "v", "length")]).join(wanted, ["dim", "block"])
        asked = asked.select(*[F.col(c).alias(c) for c in (*keys, "row", "vec_id", "v", "least")])
        return asked.groupBy(*keys).cogroup(held.select(*keys, "row", "vec_id", "v", "length").groupBy(*keys)).applyInArrow(search, FOUND)

    none = F.lit(-(2.0**80))
    first = cut_lineage(scored(queries.withColumn("block", F.lit(0)).withColumn("least", none), candidates.where("block = 0")))
    found = first
    if n_blocks > 1:
        reached = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth"))
        reached = reached.select(F.col("query").alias("row"), F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
        longest = candidates.where("block > 0").groupBy("dim", "block").agg(F.max("length").alias("longest"))
        # Lengths alone decide which blocks a query still needs; its vector follows afterwards.
        asked = queries.select("row", "dim", "chunk", "length").join(reached, "row", "left").withColumn("least", F.coalesce("kth", none))
        asked = asked.join(F.broadcast(longest), "dim").where(F.col("length") * F.col("longest") * (1 + MARGIN) + 1 >= F.col("least"))  # a row for each block
        asked = asked.select("row", "block", "least").join(queries.select("row", "vec_id", "v", "dim", "chunk"), "row")
        found = first.union(scored(asked, candidates.where("block > 0")))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _above(x, falling: list[float]):
    """How many of the falling numbers are above ``x``."""
    if len(falling) <= 1:
        return F.when(x < falling[0], 1).otherwise(0) if falling else F.lit(0)
    half = len(falling) // 2
    return F.when(x < falling[half], half + 1 + _above(x, falling[half + 1 :])).otherwise(_above(x, falling[:half]))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = numbered(whole_vectors(table(spark, sf_dir, "embeddings")))
    return top_inner_products(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


#: DuckDB: brute force.
OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 50 = 0
), ranked as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from scored)
select * from ranked where rank <= 5
"""
