"""Two-player games on arenas: vertices (v, owner), arcs (e, src, dst).

Counters need a vertex's full number of arcs, also of arcs that leave a universe, and count parallel arcs on both
sides. Dead ends: none is attracted, all lose safety and Büchi games. A vertex without an owner is the opponent's of
both players; arcs from or to vertices that are not listed count as arcs but are never moved to. Empty arenas give
empty regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import bounded
from orrery.plans.fixpoint import saved

#: A strategy with so many vertices at most is sent to all tasks, some 20 bytes each.
SENT = 4_000_000
#: Rows of plays that a task gives, about, and that it holds at once.
TASK_ROWS, HELD_ROWS = 4_000_000, 1 << 17


def opponent(player: str) -> str:
    return "Adam" if player == "Eve" else "Eve"


def attractor(vertices: DataFrame, arcs: DataFrame, target: DataFrame, player: str, universe: DataFrame | None = None) -> DataFrame:
    """(v, rank): from where player can force a visit to the target; rank is the number of moves needed.

    A round reads the arcs into the newly attracted vertices and writes only what changed: the player's vertices join
    at their first such arc, the opponent's when all of their arcs lead inside, for which the counts so far are kept."""
    inside = vertices if universe is None else vertices.join(universe.select("v"), "v", "left_semi")
    delta = saved(inside.join(target.select("v").distinct(), "v", "left_semi").select("v", F.lit(0).cast("long").alias("rank")))
    arity = arcs.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("arity"))
    need = F.when(F.col("owner") == player, F.lit(1)).otherwise(F.col("arity"))
    needs = saved(inside.join(arity, "v").select("v", need.cast("long").alias("need")))
    region, counts, n = delta, None, 0
    while not delta.isEmpty():
        n += 1
        hits = arcs.join(delta.select(F.col("v").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("v")).agg(F.count("*").alias("hits"))
        if counts is not None:
            hits = hits.unionByName(counts).groupBy("v").agg(F.sum("hits").alias("hits"))
        state = saved(needs.join(hits, "v").join(region.select("v"), "v", "left_anti"))
        delta = state.filter("hits >= need").select("v", F.lit(n).cast("long").alias("rank"))
        counts = state.filter("hits < need").select("v", "hits")
        region = region.unionByName(delta)
        if n % 8 == 0:
            region = saved(region)
    return region


def attractor_strategy(vertices: DataFrame, arcs: DataFrame, region: DataFrame, player: str) -> DataFrame:
    """(v, succ): for the player's attracted vertices outside the target, the successor of least (rank, arc id)."""
    own = region.filter("rank > 0").join(vertices.filter(F.col("owner") == player).select("v"), "v", "left_semi")
    moves = arcs.join(own.select(F.col("v").alias("src"), F.col("rank").alias("mine")), "src").join(region.select(F.col("v").alias("dst"), "rank"), "dst").filter("rank < mine")
    return moves.groupBy(F.col("src").alias("v")).agg(F.min_by("dst", F.struct("rank", "e")).alias("succ"))


def dead_ends(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    return vertices.join(arcs.select(F.col("src").alias("v")), "v", "left_anti").select("v")


def safety_region(vertices: DataFrame, arcs: DataFrame, safe: DataFrame, player: str) -> DataFrame:
    """(v): from where player can stay in safe for ever."""
    lost = vertices.join(safe.select("v"), "v", "left_anti").select("v").unionByName(dead_ends(vertices, arcs))
    return vertices.select("v").join(attractor(vertices, arcs, lost, opponent(player)).select("v"), "v", "left_anti")


def safety_strategy(vertices: DataFrame, arcs: DataFrame, region: DataFrame, player: str) -> DataFrame:
    """(v, succ): for the player's winning vertices, the first arc that stays winning."""
    own = vertices.filter(F.col("owner") == player).join(region.select("v"), "v", "left_semi").select(F.col("v").alias("src"))
    moves = arcs.join(own, "src", "left_semi").join(region.select(F.col("v").alias("dst")), "dst", "left_semi")
    return moves.groupBy(F.col("src").alias("v")).agg(F.min_by("dst", "e").alias("succ"))


def can_continue(vertices: DataFrame, arcs: DataFrame, region: DataFrame, player: str) -> DataFrame:
    """(v): the player's vertices with some, the opponent's with only and some, successors in the region."""
    mark = region.select(F.col("v").alias("dst")).distinct().withColumn("stays", F.lit(True))
    seen = arcs.join(mark, "dst", "left").groupBy(F.col("src").alias("v")).agg(F.count("stays").alias("stay"), F.count("*").alias("arity"))
    ok: Column = F.when(F.col("owner") == player, F.col("stay") > 0).otherwise(F.col("stay") == F.col("arity"))
    return vertices.join(seen, "v").filter(ok).select("v")


def buchi_region(vertices: DataFrame, arcs: DataFrame, accepting: DataFrame, player: str) -> DataFrame:
    """(v): from where player can visit accepting again and again."""
    candidate = saved(vertices.select("v"))
    while True:
        goal = accepting.select("v").distinct().join(candidate, "v", "left_semi").join(can_continue(vertices, arcs, candidate, player), "v", "left_semi")
        good = attractor(vertices, arcs, saved(goal), player, candidate)
        bad = saved(candidate.join(good.select("v"), "v", "left_anti"))
        if bad.isEmpty():
            return candidate
        lost = attractor(vertices, arcs, bad, opponent(player), candidate)
        candidate = saved(candidate.join(lost.select("v"), "v", "left_anti"))


def expanded(region: DataFrame, more: DataFrame) -> DataFrame:
    """The region (v) with more vertices (v)."""
    return region.select("v").unionByName(more.select("v")).distinct()


def contracted(region: DataFrame, fewer: DataFrame) -> DataFrame:
    """The region without some vertices (v)."""
    return region.select("v").join(fewer.select("v"), "v", "left_anti")


def included(vertices: DataFrame, region: DataFrame) -> DataFrame:
    """(v, inside) of every vertex."""
    mark = region.select("v").distinct().withColumn("inside", F.lit(True))
    return vertices.select("v").join(mark, "v", "left").fillna(False, ["inside"])


def buchi_strategy(vertices: DataFrame, arcs: DataFrame, accepting: DataFrame, region: DataFrame, player: str) -> DataFrame:
    """(v, succ): for the player's vertices of the region that buchi_region gave, moves that visit accepting again and
    again: at accepting ones the first arc that stays in the region, elsewhere the successor of least (rank, arc id) on
    the way to the next accepting one."""
    region = saved(region.select("v"))
    goal = saved(accepting.select("v").distinct().join(region, "v", "left_semi"))
    ranked = saved(attractor(vertices, arcs, goal, player, region))
    there = safety_strategy(vertices, arcs, region, player).join(goal, "v", "left_semi")
    return attractor_strategy(vertices, arcs, ranked, player).unionByName(there)


def winners(vertices: DataFrame, region: DataFrame, player: str) -> DataFrame:
    """(v, winner) of every vertex: the player in the region, the opponent elsewhere."""
    won = region.select("v").distinct().withColumn("won", F.lit(True))
    return vertices.select("v").join(won, "v", "left").select("v", F.when(F.col("won"), player).otherwise(opponent(player)).alias("winner"))


def following(vertices: DataFrame, arcs: DataFrame, strategy: DataFrame, player: str) -> DataFrame:
    """The arcs that are left when the player follows the strategy (v, succ) wherever it tells: parallel arcs to the
    chosen successor stay, as do all arcs of other vertices."""
    chosen = strategy.select(F.col("v").alias("src"), F.col("succ").alias("_to"))
    told = vertices.filter(F.col("owner") == player).select(F.col("v").alias("src")).join(chosen, "src")
    return arcs.join(told, "src", "left").filter(F.col("_to").isNull() | (F.col("_to") == F.col("dst"))).select(arcs.columns)


def insert_choice(strategy: DataFrame, v: int, succ: int) -> DataFrame:
    """The positional strategy (v, succ) with this choice at v, in place of an earlier one."""
    return remove_choice(strategy, v).unionByName(strategy.sparkSession.range(1).select(F.lit(v).cast("long").alias("v"), F.lit(succ).cast("long").alias("succ")))


def remove_choice(strategy: DataFrame, v: int) -> DataFrame:
    return strategy.filter(F.col("v") != v).select("v", "succ")


def plays(starts: DataFrame, strategy: DataFrame) -> DataFrame:
    """(start, pos, v): from every start (v) the play that follows the strategy (v, succ; one choice a vertex) until
    there is no choice or a vertex comes again, which is the play's last row.

    A strategy of up to SENT vertices goes to all tasks, which follow it from their starts and hold a few rows of the plays at
    a time; how far each play goes is found beforehand, in one task. A larger one is joined with itself, see
    doubled_plays. Starts that repeat play once, null ones not at all."""
    begun = saved(starts.filter("v is not null").select("v").distinct())
    moves = saved(strategy.filter("v is not null").select("v", "succ"))
    every = saved(moves.select(F.explode(F.array("v", "succ")).alias("v")).unionByName(begun).distinct())
    n = every.count()
    if n > SENT:
        return doubled_plays(starts, strategy)
    ids = bounded.numbers(every)
    # A choice may lead to null, where a play ends.
    to = ids.select(F.col("v").alias("_to"), F.col("i").alias("j"))
    arcs = saved(moves.join(ids, "v").join(to, F.col("succ").eqNullSafe(F.col("_to"))).select("i", "j"))
    far = bounded.solved(arcs, n, bounded.walk_lengths).withColumnRenamed("value", "moves")
    placed = saved(begun.join(ids, "v").join(far, "i", "left").select(F.col("i"), F.coalesce("moves", F.lit(0).cast("long")).alias("moves")))
    known = ids.join(arcs, "i", "left").select("i", "v", F.coalesce("j", F.lit(-1)).cast("int").alias("succ")).orderBy("i").select("v", "succ").toArrow()
    names, succ = known.column("v").combine_chunks(), known.column("succ").to_numpy()
    sent = starts.sparkSession.sparkContext.broadcast((names, succ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, succ = sent.value
        for batch in batches:
            i, moves = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(-moves, kind="stable")
            i, ends = i[order], -moves[order]
            at, pos, held, rows = i, 0, [], 0
            while len(at):
                held.append((i[: len(at)], np.full(len(at), pos, np.int64), at))
                rows += len(at)
                pos += 1
                # Plays that go on are in front.
                at = succ[at[: np.searchsorted(ends, -pos, "right")]]
                if rows >= HELD_ROWS or not len(at):
                    start, place, v = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(start)), pa.array(place), names.take(pa.array(v))], ["start", "pos", "v"])
                    held, rows = [], 0

    total = placed.agg(F.sum(F.col("moves") + 1)).first()[0] or 0
    tasks = max(starts.sparkSession.sparkContext.defaultParallelism, total // TASK_ROWS + 1)
    kind = ids.schema["v"].dataType.simpleString()
    return placed.repartition(tasks).mapInArrow(run, f"start {kind}, pos long, v {kind}")


def doubled_plays(starts: DataFrame, strategy: DataFrame) -> DataFrame:
    """As plays, for a strategy of any size: moves of 1, 2, 4, ... steps come from joining it with itself, so rounds grow
    with the logarithm of the longest play."""
    jump = saved(strategy.select("v", F.col("succ").alias("to")))
    path = saved(starts.filter("v is not null").select(F.col("v").alias("start"), F.lit(0).cast("long").alias("pos"), "v").distinct())
    size = 1
    while True:
        # Plays that have not come to a vertex again are followed twice as far.
        again = path.groupBy("start", "v").agg(F.count("*").alias("n")).filter("n > 1").select("start").distinct()
        more = saved(path.join(again, "start", "left_anti").join(jump, "v").select("start", (F.col("pos") + size).alias("pos"), F.col("to").alias("v")))
        if more.isEmpty():
            break
        path = saved(path.unionByName(more))
        jump = saved(jump.join(jump.select(F.col("v").alias("to"), F.col("to").alias("further")), "to").select("v", F.col("further").alias("to")))
        size *= 2
    turn = F.row_number().over(W.partitionBy("start", "v").orderBy("pos"))
    end = path.withColumn("turn", turn).filter("turn = 2").groupBy("start").agg(F.min("pos").alias("end"))
    return path.join(end, "start", "left").filter("end is null or pos <= end").select("start", "pos", "v")


def play(start: int, strategy: DataFrame) -> list[int]:
    """One play, as plays gives it."""
    rows = plays(strategy.sparkSession.range(start, start + 1).toDF("v"), strategy)
    return [r.v for r in rows.orderBy("pos").collect()]


def plays_with_memory(starts: DataFrame, choices: DataFrame, updates: DataFrame, first: int = 0) -> DataFrame:
    """(start, pos, v, memory): plays under a strategy with memory, whose choices are (memory, v, succ) and whose
    updates (memory, v, next) are taken on arrival; a pair without an update keeps its memory. A play ends without a
    choice or when vertex and memory come again."""
    arrive = updates.select(F.col("memory"), F.col("v").alias("succ"), "next")
    moves = choices.join(arrive, ["memory", "succ"], "left").select(F.struct("v", "memory").alias("v"), F.struct(F.col("succ").alias("v"), F.coalesce("next", "memory").alias("memory")).alias("succ"))
    states = starts.select(F.struct(F.col("v"), F.lit(first).cast(choices.schema["memory"].dataType).alias("memory")).alias("v")).filter("v.v is not null")
    found = plays(states, moves)
    return found.select(F.col("start.v").alias("start"), "pos", F.col("v.v").alias("v"), F.col("v.memory").alias("memory"))


def verify_reach_strategy(vertices: DataFrame, arcs: DataFrame, strategy: DataFrame, target: DataFrame, player: str) -> DataFrame:
    """(v): from where the target is reached whatever the opponent does, if player follows the strategy."""
    chosen = arcs.join(strategy.select(F.col("v").alias("src"), F.col("succ").alias("dst")), ["src", "dst"], "left_semi")
    other = arcs.join(vertices.filter(F.col("owner") != player).select(F.col("v").alias("src")), "src", "left_semi")
    return attractor(vertices, chosen.unionByName(other), target, player).select("v")


def objective(plays: DataFrame, marked: DataFrame) -> DataFrame:
    """(run_id, reaches, stays, recurs): visits a marked state, visits only marked states, visits one in its cycle."""
    mark = marked.select("state").distinct().withColumn("m", F.lit(True))
    rows = plays.join(mark, "state", "left").withColumn("m", F.coalesce("m", F.lit(False)))
    return rows.groupBy("run_id").agg(F.bool_or("m").alias("reaches"), F.bool_and("m").alias("stays"), F.bool_or(F.col("m") & F.col("in_cycle")).alias("recurs"))
