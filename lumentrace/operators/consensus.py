"""Groups of one feature over many runs, their evidence, and a permutation null.

``projected`` rows are run, feature_id, charge, mass, rt, im (reference
coordinates; im 0 where unknown), score.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.functions.binding import bound
from lumentrace.functions.lineage import cut_lineage
from lumentrace.operators import statistics as st
from lumentrace.operators.isotopes import neutral_mass


@dataclass(frozen=True)
class Grouping:
    ppm: float = 10.0
    #: Absolute widths, in the reference's units.
    rt: float = 1.0
    im: float = 0.05
    cohorts: int = 10
    max_q: float = 0.05


def projected(features: DataFrame) -> DataFrame:
    """Charged features with finite places (ref_mz, ref_rt, im, score) as rows to group; masses are of positive ions always."""
    mass = neutral_mass(F.col("ref_mz"), F.col("charge"))
    rows = features.where("charge > 0").select("run", "feature_id", "charge", mass.alias("mass"), F.col("ref_rt").alias("rt"), F.coalesce("im", F.lit(0.0)).alias("im"), "score")
    sound = [~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) & F.col(c).isNotNull() for c in ("mass", "rt", "im", "score")]
    for s in sound:
        rows = rows.where(s)
    return rows.where("mass > 0")


#: Quality order: the best score first, then what tells rows apart.
ORDER = ["charge", "mass", "rt", "im", "run", "feature_id"]


#: A group's spans: its seed's place and rank, and the least and greatest of its members.
STATE = ["seed_mass", "seed_rt", "seed_im", "mass_low", "mass_high", "rt_low", "rt_high", "im_low", "im_high"]


def _fits(g: list, mass: float, rt: float, im: float, o: Grouping) -> float | None:
    """Squared distance from the seed of a group that keeps its spans with a row; None where it does not."""
    seed_mass, seed_rt, seed_im, mass_low, mass_high, rt_low, rt_high, im_low, im_high = g
    low, high = min(mass_low, mass), max(mass_high, mass)
    if (high - low) / low * 1e6 > o.ppm or max(rt_high, rt) - min(rt_low, rt) > o.rt:
        return None
    if im_low is not None:
        low, high = (min(im_low, im), max(im_high, im)) if im != 0 else (im_low, im_high)
        if high - low > o.im:
            return None
    far = ((mass - seed_mass) / seed_mass * 1e6 / max(o.ppm, 1e-12)) ** 2 + ((rt - seed_rt) / max(o.rt, 1e-12)) ** 2
    return far + (((im - seed_im) / max(o.im, 1e-12)) ** 2 if im != 0 and seed_im != 0 else 0.0)


class _Block:
    """What a task knows of a block: groups by their seeds' masses, and where better rows still wait."""

    def __init__(self, o: Grouping):
        self.o, self.masses, self.groups, self.changed, self.waiting = o, [], {}, set(), {}

    def add(self, rank: tuple, name: str, state: list) -> None:
        insort(self.masses, (state[0], rank))
        self.groups[rank] = [name, state]

    def waits(self, cell: tuple[int, int], rank: tuple) -> bool:
        near = ((cell[0] + i, cell[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1))
        if any(c in self.waiting and self.waiting[c] < rank for c in near):
            self.waiting[cell] = min(self.waiting.get(cell, rank), rank)
            return True
        return False

    def place(self, rank: tuple, name: str, mass: float, rt: float, im: float) -> str:
        """The name of the nearest group, the older of equally near ones, which takes the row in; its own otherwise."""
        best, ratio = None, 1 + self.o.ppm * 1e-6
        at = bisect_left(self.masses, (mass / ratio,))
        while at < len(self.masses) and self.masses[at][0] <= mass * ratio:
            seed = self.masses[at][1]
            far = _fits(self.groups[seed][1], mass, rt, im, self.o)
            if far is not None and (best is None or (far, seed) < best):
                best = (far, seed)
            at += 1
        has = im if im != 0 else None
        if best is None:
            self.add(rank, name, [mass, rt, im, mass, mass, rt, rt, has, has])
            self.changed.add(rank)
            return name
        name, g = self.groups[best[1]]
        g[3:7] = min(g[3], mass), max(g[4], mass), min(g[5], rt), max(g[6], rt)
        if has is not None:
            g[7:] = (im, im) if g[7] is None else (min(g[7], im), max(g[8], im))
        self.changed.add(best[1])
        return name


def clusters(rows: DataFrame, o: Grouping = Grouping(), by: tuple[str, ...] = (), side: int = 32) -> DataFrame:
    """``rows`` with ``group_id`` (the seed's run and feature): greedy groups of bounded spans.

    In quality order a row joins the group whose seed is nearest among those
    that keep their whole mass, time and mobility spans with it, the older of
    equally near ones, or starts its own.  ``by`` names columns whose values are
    grouped apart.

    The order is kept without one task going through all of it: what a row does
    depends on better rows within twice the tolerances only.  Mass and time are
    cut into squares that wide, ``side`` by ``side`` squares are a block, and a
    task takes its block's rows in order, as a stream.  A row waits for the next
    round if a better one that waits, or is another block's, lies in its square
    or one beside it.  Blocks move by half their width from round to round; the
    best row of all never waits.
    """
    keys = [*by, "charge"]
    wide = 2 * math.log1p(o.ppm * 1e-6) * (1 + 1e-9)
    square = F.struct(F.floor(F.log("mass") / max(wide, 1e-12)).alias("x"), F.floor(F.col("rt") / max(2 * o.rt * (1 + 1e-9), 1e-9)).alias("y"))
    rank = F.struct((-F.col("score")).alias("score"), *ORDER[1:])
    kept = rows.columns
    open_ = cut_lineage(rows.select(F.struct(*kept).alias("row"), *[F.col(c).alias(f"key_{c}") for c in keys], rank.alias("rank"), square.alias("square")))
    key = [f"key_{c}" for c in keys]
    kinds = {c: open_.schema[c].dataType.simpleString() for c in ("row", *key, "rank", "square")}
    state_kind = "struct<" + ",".join(f"{c}:double" for c in STATE) + ">"
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    held, settled, turn = None, None, 0

    def solve(batches):
        now, block = None, None
        for part in batches:
            out = []
            for r in part.to_dict("records"):
                at = tuple(r[k] for k in key) + (r["block"]["x"], r["block"]["y"])
                if at != now:
                    out += finished(block, now)
                    now, block = at, _Block(o)
                rank, cell = tuple(r["rank"][c] for c in ("score", *ORDER[1:])), (r["square"]["x"], r["square"]["y"])
                if r["kind"] == 0:
                    block.add(rank, r["group_id"], [r["state"][c] for c in STATE])
                elif r["kind"] == 1:
                    block.waiting[cell] = rank
                else:
                    wait = block.waits(cell, rank)
                    name = None if wait else block.place(rank, f"{r['rank']['run']}:{r['rank']['feature_id']}", r["rank"]["mass"], r["rank"]["rt"], r["rank"]["im"])
                    out.append({k: r[k] for k in ("row", *key, "rank", "square")} | {"group_id": name, "state": None})
            if out:
                yield framed(out)
        if block is not None and block.changed:
            yield framed(finished(block, now))

    def finished(block, now):
        names = ["score", *ORDER[1:]]
        return [] if block is None else [dict(zip(key, now)) | {"row": None, "rank": dict(zip(names, k)), "square": None, "group_id": block.groups[k][0], "state": dict(zip(STATE, block.groups[k][1]))} for k in block.changed]

    def framed(out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["row", *key, "rank", "square", "group_id", "state"], dtype=object)

    while True:
        moved = lambda c: F.struct(*[F.floor((F.col(f"{c}.{a}") + turn * side // 2) / side).alias(a) for a in ("x", "y")])  # noqa: B023, E731
        around = lambda c: F.array(*[F.struct((F.col(f"{c}.x") + i).alias("x"), (F.col(f"{c}.y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        mine = open_.select(*key, moved("square").alias("block"), F.lit(2).alias("kind"), "rank", "square", "row", none("group_id", "string"), none("state", state_kind))
        # The best waiting row of each square, for the blocks beside it.
        best = open_.groupBy(*key, "square").agg(F.min("rank").alias("rank")).withColumn("near", F.explode(around("square")))
        best = best.select(*key, moved("near").alias("block"), F.lit(1).alias("kind"), "rank", "square", none("row", kinds["row"]), none("group_id", "string"), none("state", state_kind), moved("square").alias("own")).where(F.col("block") != F.col("own")).drop("own").distinct()
        every = mine.unionByName(best)
        if held is not None:
            seeds = held.withColumns({"mass": F.col("state.seed_mass"), "rt": F.col("state.seed_rt")}).withColumn("square", square)
            near = seeds.withColumn("near", F.explode(around("square"))).select(*key, moved("near").alias("block"), F.lit(0).alias("kind"), "rank", "square", none("row", kinds["row"]), "group_id", "state").distinct()
            every = every.unionByName(near.join(mine.select(*key, "block").distinct(), [*key, "block"], "left_semi"))
        sorted_ = every.repartition(*key, "block").sortWithinPartitions(*key, "block", "kind", "rank")
        done = cut_lineage(sorted_.mapInPandas(solve, f"row {kinds['row']}, " + ", ".join(f"{k} {kinds[k]}" for k in key) + f", rank {kinds['rank']}, square {kinds['square']}, group_id string, state {state_kind}"))
        placed = done.where("row is not null and group_id is not null").select("row.*", "group_id")
        settled = placed if settled is None else settled.unionByName(placed)
        open_ = done.where("row is not null and group_id is null").select("row", *key, "rank", "square")
        if open_.isEmpty():
            return settled
        fresh = done.where("state is not null").select(*key, "rank", "group_id", "state.*")
        both = fresh if held is None else fresh.unionByName(held.select(*key, "rank", "group_id", "state.*"))
        # Spans only grow, so the widest of a group's states is its last.
        ends = [(F.max if c.endswith("high") else F.min)(c).alias(c) for c in STATE]
        held = cut_lineage(both.groupBy(*key, "rank", "group_id").agg(*ends).select(*key, "rank", "group_id", F.struct(*STATE).alias("state")))
        turn += 1


def groups(members: DataFrame, o: Grouping = Grouping(), by: tuple[str, ...] = ()) -> DataFrame:
    """by, charge, group_id, mass, rt, im (the seed's), score (its own), n_members, n_runs, primaries (the best row of each run), group_score.

    A pair of runs adds the root of their qualities' product times
    exp(-2 d^2), d in tolerances; a run's quality is its best score squared over
    all its scores; the sum is divided by the number of runs less one.
    """
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    rank = F.struct((-F.col("score")).alias("s"), *ORDER)
    keys = [*by, "charge", "group_id"]
    own = members.withColumn("q", q).groupBy(*keys, "run").agg(F.count("*").alias("n"), F.sum("q").alias("whole"), F.min(F.struct(rank.alias("rank"), "mass", "rt", "im", "score", "feature_id", "q")).alias("b"))
    quality = F.when(F.col("whole") > 0, F.col("b.q") * F.col("b.q") / F.col("whole")).otherwise(0.0)
    own = own.select(*keys, "run", "n", F.struct("run", "b.mass", "b.rt", "b.im", "b.score", "b.feature_id", quality.alias("quality"), "b.rank").alias("p"))
    out = own.groupBy(*keys).agg(F.sum("n").alias("n_members"), F.count("*").alias("n_runs"), F.sort_array(F.collect_list("p")).alias("primaries"), F.min_by("p", "p.rank").alias("seed"))  # a row for each run

    def affinity(a, b):
        far = ((a.mass - b.mass) / F.least(a.mass, b.mass) * 1e6 / o.ppm) ** 2 + ((a.rt - b.rt) / o.rt) ** 2
        far = far + F.when((a.im != 0) & (b.im != 0), ((a.im - b.im) / o.im) ** 2).otherwise(0.0)
        return F.sqrt(a.quality * b.quality) * F.exp(-2 * far)

    total = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda s, j: s + F.aggregate(F.slice(p, 1, j), F.lit(0.0), lambda t, a: t + affinity(a, F.get(p, j))))
    score = F.when(F.col("n_runs") < 2, 0.0).otherwise(bound(F.col("primaries"), total) / (F.col("n_runs") - 1))
    return out.select(*keys, "seed.mass", "seed.rt", "seed.im", "seed.score", "n_members", "n_runs", "primaries", score.alias("group_score"))


def permuted(rows: DataFrame, cohorts: int = 10, seed: int = 0) -> DataFrame:
    """``rows`` with ``cohort``: times shuffled within each run, charge and tenth of the score, the same on every run."""
    keys = ["run", "charge", "tenth"]
    tenth = F.least(F.lit(9), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))) * 10))
    rows = rows.withColumn("tenth", tenth).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("rt", F.desc("score"), *ORDER)))
    each = rows.withColumn("cohort", F.explode(F.sequence(F.lit(0), F.lit(cohorts - 1))))
    drawn = Window.partitionBy(*keys, "cohort").orderBy(F.xxhash64("nth", "cohort", *keys, F.lit(seed)), "nth")
    times = each.select(*keys, "cohort", F.col("rt").alias("new_rt"), F.row_number().over(drawn).alias("nth"))
    return each.join(times, [*keys, "cohort", "nth"]).select(*[F.col("new_rt").alias("rt") if c == "rt" else F.col(c) for c in rows.columns if c not in ("tenth", "nth")], "cohort")


def shifted(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Another control: each run's times moved around by ``share`` of their number of ranks."""
    window = Window.partitionBy("run")
    ranked = rows.withColumn("nth", F.row_number().over(window.orderBy("rt", *ORDER)) - 1).withColumn("n", F.count("*").over(window))
    times = ranked.select("run", F.col("rt").alias("new_rt"), F.pmod(F.col("nth") + F.floor(F.col("n") * share), F.col("n")).alias("nth"))
    return ranked.join(times, ["run", "nth"]).select(*[F.col("new_rt").alias("rt") if c == "rt" else F.col(c) for c in rows.columns])


def confident(rows: DataFrame, o: Grouping = Grouping()) -> DataFrame:
    """``groups`` of ``rows`` with q from ``cohorts`` permuted copies, grouped and scored the same way."""
    rows = cut_lineage(rows)
    found = cut_lineage(groups(clusters(rows, o), o))
    null = groups(clusters(permuted(rows, o.cohorts), o, by=("cohort",)), o, by=("cohort",))
    q = st.group_q(found.select(F.col("group_score").alias("score")), null.select(F.col("group_score").alias("score")), o.cohorts)
    return found.join(q.select(F.col("score").alias("group_score"), "q"), "group_score")


def gated(found: DataFrame, o: Grouping = Grouping()) -> DataFrame:
    return found.where((F.col("n_runs") >= 2) & (F.col("q") <= o.max_q))
