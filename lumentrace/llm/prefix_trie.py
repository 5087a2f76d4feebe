"""Prefix trie of conversations: who shares which opening turns.

Turns are known by the SHA-256 of their role and text.  The table is
range-sorted by conversation and turn; a numpy scan of each partition gives
every turn its place and the polynomial fingerprint of the turns up to it (the
sum of digest times base^place, modulo two primes of 31 bits).  A conversation
may go over several partitions: what came before in it is carried over by a
table of two rows a partition at most.  Prefix sums of a shared opening and of
a conversation's own turns add up to those of the rebuilt conversation, which
therefore needs no second scan.

Rows of one depth and fingerprint are a candidate node.  It is verified turn by
turn: all members' last turns must have the digest of its representative (the
smallest conv_id), and all their prefixes before must be one node; least and
greatest of each are compared, which sums up in map tasks however many members
there are.  From a node that fails on, its members get a further fingerprint of
other bases, until all verify.

Rollup needs no walk over depths.  A conversation represents the nodes from
some depth on to its end, so each node belongs to one row of one conversation,
and a sum over a subtree is a sum over the node's members of what their own
rows from there on add up to.

Edge cases: rows without conv_id take no part; turns of one number go by
digest, repeated rows count each; null roles and texts are empty; a
conversation without turns is a member of the root only; a conversation's
first turns come from ``conv_id - conv_id % 100``, with the remainder's sign
that of the id; an empty table has no nodes, not even the root; columns besides
conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import cut_lineage, table

#: Conversations of one hundred share an opening of fewer than ``MOST_SHARED`` + 1 turns.
SHARERS, MOST_SHARED = 100, 5
#: The two largest primes below 2^31.
PRIMES = (2147483647, 2147483629)
#: Ids that one row of a list of ends holds.
IDS_A_CHUNK = 512
DIGEST = ["k0", "k1", "k2", "k3"]


def bases(seed: int) -> tuple[int, int]:
    """Two numbers below any of the primes, drawn from a seed."""
    found = hashlib.sha256(f"prefix {seed}".encode()).digest()
    return tuple(int.from_bytes(found[i : i + 8], "big") % (2**30) + 2 for i in (0, 8))


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base^exponent modulo a prime below 2^31."""
    out, square, left = np.full(len(exponents), 1 % prime, np.int64), base % prime, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def power_of(base: int, exponent: Column, prime: int) -> Column:
    """The same for a column."""
    squares = [base % prime]
    while len(squares) < 40:
        squares.append(squares[-1] ** 2 % prime)
    found = F.aggregate(F.arrays_zip(F.array(*map(F.lit, range(40))).alias("bit"), F.array(*[F.lit(s).cast("long") for s in squares]).alias("square")), F.lit(1).cast("long"), lambda held, x: F.when(F.getbit(exponent, x.bit) == 1, held * x.square % prime).otherwise(held))
    return F.when(exponent == 0, F.lit(1 % prime).cast("long")).otherwise(found)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, chars."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def _words(digests: pa.Array) -> np.ndarray:
    """The four 64-bit numbers of each digest."""
    return np.frombuffer(b"".join(digests.to_pylist()), ">i8").astype(np.int64).reshape(-1, 4)


SCANNED = "conv_id long, piece int, at long, k0 long, k1 long, k2 long, k3 long, chars long, s1 long, s2 long, b1 long, b2 long, cum long"


def _scanner(seed: int, primes: tuple[int, int]):
    def scan(batches):
        """Places and prefix sums of sorted rows, from the partition's start; b1, b2 are the sums before a row."""
        piece, last, carried = TaskContext.get().partitionId(), None, [0, 0, 0, 0]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, chars = batch.column("conv_id").to_numpy(), batch.column("chars").to_numpy()
            words = _words(batch.column("digest"))
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
            goes_on = (group == 0) & (last is not None and conv[0] == last)
            at = np.arange(n) - starts[group] + 1 + np.where(goes_on, carried[0], 0)

            def summed(values, before):
                upto = np.cumsum(values)
                return upto - (upto - values)[starts[group]] + np.where(goes_on, before, 0)

            columns = [at]
            for k, (base, prime) in enumerate(zip(bases(seed), primes)):
                term = words[:, k] % prime * powers(base, at, prime) % prime
                columns += [upto := summed(term, carried[k + 1]) % prime, (upto - term) % prime]
            cum = summed(chars, carried[3])
            last, carried = conv[-1], [int(at[-1]), int(columns[1][-1]), int(columns[3][-1]), int(cum[-1])]
            arrays = [conv, np.full(n, piece, np.int32), at, *words.T, chars, columns[1], columns[3], columns[2], columns[4], cum]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in arrays], names=[c.split()[0] for c in SCANNED.split(", ")])

    return scan


def prefixed(rows: DataFrame, order: list[Column], seed: int = 0, primes: tuple[int, int] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """(conv_id, piece, at, digest words, chars, s1, s2, b1, b2, cum), (conv_id, piece, n, chars): rows in order and the pieces they lie in.

    ``rows`` has conv_id, digest, chars.  What pieces before hold of a
    conversation comes by broadcast: two rows a partition at most, since a
    partition shares only its first and its last conversation with others.
    """
    order = [F.col("conv_id"), *order]
    found = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "chars").mapInArrow(_scanner(seed, primes), SCANNED))
    pieces = found.groupBy("conv_id", "piece").agg(F.max("at").alias("n"), F.max("cum").alias("chars"), F.max_by("s1", "at").alias("s1"), F.max_by("s2", "at").alias("s2"))
    pieces = cut_lineage(pieces)
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    several = pieces.withColumn("of", F.count("*").over(Window.partitionBy("conv_id"))).where("of > 1")
    held = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    several = several.withColumns({"off": held("n"), "off_chars": held("chars")})
    moved = {f"m{k}": power_of(b, F.col("off"), p) for k, (b, p) in enumerate(zip(bases(seed), primes), 1)}
    several = several.withColumns(moved).withColumns({f"t{k}": F.col(f"m{k}") * F.col(f"s{k}") % p for k, p in enumerate(primes, 1)})
    several = several.select("conv_id", "piece", "off", "off_chars", "m1", "m2", *[(held(f"t{k}") % p).alias(f"o{k}") for k, p in enumerate(primes, 1)])
    out = found.join(F.broadcast(several), ["conv_id", "piece"], "left")
    of = lambda c, none: F.coalesce(F.col(c), F.lit(none))
    whole = [((of(f"o{k}", 0) + of(f"m{k}", 1) * F.col(f"{s}{k}")) % p).alias(f"{s}{k}") for k, p in enumerate(primes, 1) for s in ("s", "b")]
    return out.select("conv_id", "piece", (of("off", 0) + F.col("at")).alias("at"), *DIGEST, "chars", *whole, (of("off_chars", 0) + F.col("cum")).alias("cum")), pieces.select("conv_id", "piece", "n", "chars")


def _packed(one, two) -> Column:
    return one * (1 << 31) + two


def rebuilt(rows: DataFrame, pieces: DataFrame, shared: Column, seed: int = 0, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Rows of the conversations that begin with the first ``shared`` turns of their hundred's first one, the root (depth 0) included.

    conv_id, piece, depth, f and b (fingerprints up to and before the turn),
    digest words, chars, before (code points before the turn), len and total
    (turns and code points of the conversation), turn_conv_id and turn_place
    (where the turn is from).
    """
    names = ["at", *DIGEST, "chars", "s1", "s2", "b1", "b2", "cum"]
    heads = rows.where(F.col("at") <= MOST_SHARED).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("head"))  # MOST_SHARED turns at most
    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("own"), F.sum("chars").alias("own_chars")).join(heads, "conv_id")
    convs = convs.withColumns({"h": shared.cast("int"), "base": F.col("conv_id") - F.col("conv_id") % SHARERS})
    of_base = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("head").alias("base_head"))
    convs = convs.join(of_base, "base", "left").withColumn("base_head", F.slice(F.coalesce("base_head", F.array().cast(convs.schema["head"].dataType)), 1, F.col("h")))
    convs = convs.withColumn("n_base", F.size("base_head"))
    last = lambda a, n, c: F.coalesce(F.get(a, n - 1)[c], F.lit(0))
    skipped = F.least(F.col("h"), F.size("head"))
    held = {f"own_{c}": last(F.col("head"), skipped, c) for c in ("s1", "s2", "cum")} | {f"base_{c}": last(F.col("base_head"), F.col("n_base"), c) for c in ("s1", "s2", "cum")}
    convs = convs.withColumns(held)
    convs = convs.withColumns({"len": F.col("n_base") + F.greatest(F.lit(0), F.col("own") - F.col("h")), "total": F.col("base_cum") + F.col("own_chars") - F.col("own_cum")})
    convs = cut_lineage(convs.drop("head", "own", "own_chars"))
    wanted = ["h", "n_base", "len", "total", *[f"{a}_{c}" for a in ("own", "base") for c in ("s1", "s2", "cum")]]
    # By piece, so that a conversation of many turns is many keys.
    own = rows.join(pieces.select("conv_id", "piece").join(convs.select("conv_id", *wanted), "conv_id"), ["conv_id", "piece"]).where(F.col("at") > F.col("h"))
    back = {k: [pow(pow(b, -1, p), i, p) if b % p else 0 for i in range(MOST_SHARED + 1)] for k, (b, p) in enumerate(zip(bases(seed), primes), 1)}
    off = lambda k: F.get(F.array(*[F.lit(x).cast("long") for x in back[k]]), F.col("h") - F.col("n_base"))

    def moved(s: str) -> Column:
        return _packed(*[(F.col(f"base_s{k}") + F.pmod(F.col(f"{s}{k}") - F.col(f"own_s{k}"), F.lit(p)) * off(k)) % p for k, p in enumerate(primes, 1)])

    ends = [F.col("len").cast("long").alias("len"), "total"]
    own = own.select("conv_id", "piece", (F.col("at") - F.col("h") + F.col("n_base")).alias("depth"), moved("s").alias("f"), moved("b").alias("b"), *DIGEST, "chars", (F.col("base_cum") + F.col("cum") - F.col("own_cum") - F.col("chars")).alias("before"), *ends, F.col("conv_id").alias("turn_conv_id"), F.col("at").alias("turn_place"))
    t = F.col("t")
    base = convs.select("conv_id", F.lit(-1).alias("piece"), "len", "total", "base", F.explode("base_head").alias("t"))
    base = base.select("conv_id", "piece", t["at"].alias("depth"), _packed(t["s1"], t["s2"]).alias("f"), _packed(t["b1"], t["b2"]).alias("b"), *[t[c].alias(c) for c in DIGEST], t["chars"].alias("chars"), (t["cum"] - t["chars"]).alias("before"), *ends, F.col("base").alias("turn_conv_id"), t["at"].alias("turn_place"))
    zero = lambda c: F.lit(0).cast("long").alias(c)
    none = lambda c: F.lit(None).cast("long").alias(c)
    root = convs.select("conv_id", F.lit(-1).alias("piece"), *map(zero, ["depth", "f", "b", *DIGEST, "chars", "before"]), *ends, none("turn_conv_id"), none("turn_place"))
    return own.unionByName(base).unionByName(root)


NODE = ["depth", "f", "e"]


def verified(rows: DataFrame, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows with e and be, the further fingerprints of their node and the one before; their candidate nodes), all of one sequence each."""
    rows = cut_lineage(rows.withColumns({"e": F.lit(0).cast("long"), "be": F.lit(0).cast("long")}))
    for seed in range(1, rounds + 1):
        same = [F.min(c) == F.max(c) for c in ("b", "be", *DIGEST)]
        whole = same[0]
        for s in same[1:]:
            whole = whole & s
        nodes = cut_lineage(rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("len").alias("longest"), F.min_by("before", "conv_id").alias("before"), whole.alias("whole")))
        split = nodes.where("not whole")
        if split.isEmpty():
            return rows, nodes
        # Members of such nodes, from there on, also go by a fingerprint of other bases.
        since = rows.join(split.select(*NODE), NODE).groupBy("conv_id").agg(F.min("depth").alias("since"))
        digest = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in DIGEST]))
        again, _ = prefixed(rows.where("depth > 0").join(since, "conv_id", "left_semi").select("conv_id", "depth", digest.alias("digest"), "chars"), [F.col("depth")], seed)
        more = again.select("conv_id", F.col("at").alias("depth"), _packed(F.col("s1"), F.col("s2")).alias("f2"), _packed(F.col("b1"), F.col("b2")).alias("b2"))
        near = rows.join(since, "conv_id", "left").join(more, ["conv_id", "depth"], "left")
        e = F.when(F.col("depth") >= F.col("since"), F.xxhash64("e", "f2")).otherwise(F.col("e"))
        be = F.when(F.col("depth") > F.col("since"), F.xxhash64("be", "b2")).otherwise(F.col("be"))
        rows = cut_lineage(near.select(*[c for c in rows.columns if c not in ("e", "be")], e.alias("e"), be.alias("be")))
    raise ValueError("fingerprints keep colliding")


def ends_digest(rows: DataFrame) -> DataFrame:
    """NODE, ends_sha256: of the decimal conv_ids of the rows that end there, ascending, joined by commas.

    Ids are sorted over all tasks and joined in chunks; a node's chunks, far
    fewer than its ids, then stream through one hash.
    """
    order = [*NODE, "conv_id"]
    ends = rows.where(F.col("depth") == F.col("len")).select(*order)

    def chunks(batches):
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in NODE])
            ids = batch.column("conv_id").to_pylist()
            new = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])[: len(ids)]
            cuts = [a for s, e in zip(new, [*new[1:], len(ids)]) for a in range(s, e, IDS_A_CHUNK)]
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*[pa.array(k[cuts]) if cuts else pa.array([], pa.int64()) for k in keys], pa.array([ids[a] for a in cuts], pa.int64()), pa.array(texts, pa.string())], names=[*order, "ids"])

    def hashed(batches):
        held, state = None, None
        for batch in batches:
            done = []
            for *key, text in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if key != held:
                    if held is not None:
                        done.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            yield _ended(done)
        if held is not None:
            yield _ended([(*held, state.hexdigest())])

    kinds = "depth long, f long, e long"
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, f"{kinds}, conv_id long, ids string")
    return parts.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(hashed, f"{kinds}, ends_sha256 string")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])


def trie(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_conv_id, turn_place of ``verified`` rows and nodes."""
    # From depth ``first`` on a conversation represents its nodes; ``leaf``: its end is a childless one of them.
    own = nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.min_by("before", "depth").alias("first_before"), F.max(F.col("depth") == F.col("longest")).alias("leaf"))
    pieces = rows.select("conv_id", "piece").distinct()
    near = rows.join(pieces.join(own, "conv_id"), ["conv_id", "piece"], "left")
    first = F.coalesce("first", F.col("len") + 1)
    tokens = F.when(F.col("depth") >= first, 0).otherwise(F.col("total") - F.col("before") - F.when(first <= F.col("len"), F.col("total") - F.col("first_before")).otherwise(0))
    found = near.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if((first <= F.col("depth") + 1) & (F.col("depth") < F.col("len"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"), F.sum(tokens).alias("saved_tokens"), F.min("b").alias("b"), F.min("be").alias("be"), F.min_by("first", "conv_id").alias("first"),
        F.min_by("turn_conv_id", "conv_id").alias("turn_conv_id"), F.min_by("turn_place", "conv_id").alias("turn_place"),
    )
    found = cut_lineage(found)
    # Below its first node a conversation's parents are its own; a row for each conversation looks its parent up.
    tops = found.where("depth = first and depth > 0").select(*NODE, (F.col("depth") - 1).alias("d"), "b", "be")
    above = found.select(F.col("depth").alias("d"), F.col("f").alias("b"), F.col("e").alias("be"), F.col("conv_id").alias("parent"))
    parents = tops.join(above, ["d", "b", "be"]).select(*NODE, "parent")
    out = found.join(parents, NODE, "left").join(ends_digest(rows), NODE, "left")
    parent = F.when(F.col("depth") == 0, F.lit(None)).otherwise(F.coalesce("parent", "conv_id"))
    return out.select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "turn_conv_id", "turn_place")


def shared_turns() -> Column:
    """How many opening turns a conversation takes from its hundred's first."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)


def prefix_trie(conversations: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    rows, pieces = prefixed(turns(conversations), [F.col("turn").asc_nulls_first(), F.col("digest")], 0, primes)
    return trie(*verified(rebuilt(rows, pieces, shared_turns(), 0, primes)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("turn_conv_id", "turn_place")


#: DuckDB: whole prefixes as keys; the id's CRC-32 from its table.
OP12_SQL = """
with tab as (
  select list(x order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as x from range(256) r(i))
), own as (
  select conv_id as c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} order by turn nulls first, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as o
  from conversations where conv_id is not null group by conv_id
), hs as (
  select c, o, (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda z: ord(z)::bigint)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::bigint) % 6)::int as h from own, tab
), seqs as (select a.c, list_concat(coalesce(list_slice(b.o, 1, a.h), []), list_slice(a.o, a.h + 1, len(a.o))) as s from hs a left join own b on b.c = a.c - a.c % 100),
pre as (select c, d::int as d, list_slice(s, 1, d::int) as p, len(s) = d as ends from seqs, lateral (select unnest(range(0, len(s) + 1)) as d) r),
nodes as (select p, d, min(c) as conv_id, count(*) as n, coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '') as e from pre group by p, d),
kids as (select list_slice(p, 1, d - 1) as p, count(*) as k from nodes where d > 0 group by 1),
x as (select nodes.*, coalesce(k, 0) as k, case when d = 0 then 0 else (n - 1) * length(p[d].x) end as own from nodes left join kids using (p)),
sub as (select list_slice(p, 1, a::int) as p, count(*) filter (k = 0) as leaves, sum(own) as saved from x, lateral (select unnest(range(0, d + 1)) as a) r group by 1)
select x.conv_id, x.d::bigint as depth, up.conv_id as parent_conv_id, x.n as n_convs, x.k as n_children, leaves as n_leaves, saved::bigint as saved_tokens, sha256(x.e) as ends_sha256
from x join sub on sub.p = x.p left join nodes up on x.d > 0 and up.d = x.d - 1 and up.p = list_slice(x.p, 1, x.d - 1)
"""
