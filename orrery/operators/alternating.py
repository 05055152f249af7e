"""Lassos and words through automata.

An alternating automaton (clauses: state, letter, clause, succ) reads a lasso (run_id, pos, letter, in_cycle) as a game on
places and states: at a place Eve picks a clause of the state under the place's letter, Adam picks one of the clause's
successors, and the play goes on at the next place, from the last one to the cycle's first. A run is accepted if Eve
can visit accepting states again and again. Each run is solved inside a task, on sets of states; runs of very many places
and automata of very many clauses are solved as one arena instead, so rounds do not grow with their number."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import games
from orrery.plans.fixpoint import grow, saved

#: Rows of clauses that are sent to all tasks at most, places of a run that a task takes at most, and solved lassos that it keeps.
CLAUSES, PLACES, KEPT = 100_000, 1_000_000, 100_000


def places(runs: DataFrame) -> DataFrame:
    """runs with next: the place after each; null behind the last one of a run without a cycle."""
    whole = W.partitionBy("run_id")
    first = F.min(F.when(F.col("in_cycle"), F.col("pos"))).over(whole)
    return runs.withColumn("next", F.coalesce(F.lead("pos").over(whole.orderBy("pos")), first))


def product_arena(clauses: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, owner, run_id, pos, state) and arcs (e, src, dst) of the game; Eve's vertices are places with a state.

    A clause without a successor (null) is true: it leads to a vertex of its run where Eve's plays stay for ever (pos
    null). A state without a clause under a place's letter is a dead end, and so is the end of a run without a cycle."""
    at = lambda pos, state, clause: F.struct(F.col("run_id").alias("run_id"), pos.alias("pos"), state.alias("state"), clause.alias("clause"))
    kinds = {c: dict(clauses.dtypes)[c] for c in ("state", "clause")} | {"pos": dict(runs.dtypes)["pos"]}
    none = {c: F.lit(None).cast(t) for c, t in kinds.items()}
    read = saved(places(runs).join(clauses.select("state", "letter", "clause", "succ").distinct(), "letter"))
    here, chosen = at(F.col("pos"), F.col("state"), none["clause"]), at(F.col("pos"), F.col("state"), F.col("clause"))
    home = at(none["pos"], none["state"], none["clause"])
    there = F.when(F.col("succ").isNull(), home).when(F.col("next").isNotNull(), at(F.col("next"), F.col("succ"), none["clause"]))
    picks = read.select(here.alias("src"), chosen.alias("dst")).distinct()
    answers = read.select(chosen.alias("src"), there.alias("dst")).filter("dst is not null").distinct()
    stay = read.filter("succ is null").select(home.alias("src"), home.alias("dst")).distinct()
    arcs = saved(picks.unionByName(answers).unionByName(stay))
    ends = arcs.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    owner = F.when(F.col("v.clause").isNull(), "Eve").otherwise("Adam")
    vertices = saved(ends.select("v", owner.alias("owner"), "v.run_id", "v.pos", "v.state"))
    return vertices, arcs.withColumn("e", F.monotonically_increasing_id())


def winning(steps: dict, accepting: int, letters: tuple, first: int) -> int:
    """The states (bits) from which Eve wins at the first place of a lasso whose cycle begins at place first, below 0 if there
    is none. steps has (state, all of the clause's successors) as bits for each clause of a letter.

    On the cycle a greatest fixpoint over least ones is found by sweeps against the letters; a least one takes no more sweeps
    than there are states, as those at the cycle's first place change with each. Before the cycle she only has to get there."""

    def before(letter, good: int) -> int:
        found = 0
        for state, succ in steps.get(letter, ()):
            if succ & good == succ:
                found |= state
        return found

    good = 0
    if first >= 0:
        turns = range(len(letters) - 1, first - 1, -1)
        kept = [-1] * len(letters)
        while True:
            now, entry = [0] * len(letters), 0
            while True:
                good = entry
                for p in turns:
                    again = kept[p + 1] if p + 1 < len(letters) else kept[first]
                    now[p] = good = before(letters[p], good) | (accepting & before(letters[p], again))
                if good == entry:
                    break
                entry = good
            if now[first:] == kept[first:]:
                break
            kept = now
    for letter in reversed(letters[:first] if first >= 0 else letters):
        good = before(letter, good)
    return good


def accepted_lassos(clauses: DataFrame, runs: DataFrame, accepting: DataFrame, initial) -> DataFrame:
    """(run_id, accepted) of every run, from the state `initial` at its first place; accepting: (state)."""
    clauses = saved(clauses.select("state", "letter", "clause", "succ").distinct())
    runs = saved(runs.select("run_id", "pos", "letter", "in_cycle"))
    longest = runs.groupBy("run_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if clauses.count() > CLAUSES or longest > PLACES:
        return accepted_in_arena(clauses, runs, accepting, initial)
    bits, each = {}, {}
    bit = lambda state: 1 << bits.setdefault(state, len(bits))
    for r in clauses.filter("state is not null and letter is not null and clause is not null").collect():
        key = r.letter, r.state, r.clause
        each[key] = each.get(key, 0) | (0 if r.succ is None else bit(r.succ))
    steps: dict = {}
    for (letter, state, _), succ in each.items():
        steps.setdefault(letter, []).append((bit(state), succ))
    goal, start = sum(bit(r.state) for r in accepting.select("state").distinct().collect()), bit(initial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            out = []
            for letters, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key = first, *letters
                if key not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    known[key] = winning(steps, goal, key[1:], first) & start != 0
                out.append(known[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_())], ["run_id", "accepted"])

    rows = F.array_sort(F.collect_list(F.struct("pos", "letter", "in_cycle")))
    whole = runs.groupBy("run_id").agg(rows.alias("x"))
    first = F.array_position(F.transform("x", lambda x: F.coalesce(x["in_cycle"], F.lit(False))), True).cast("int") - 1
    return whole.select("run_id", F.transform("x", lambda x: x["letter"]).alias("letters"), first.alias("first")).mapInArrow(run, f"run_id {runs.schema['run_id'].dataType.simpleString()}, accepted boolean")


def accepted_in_arena(clauses: DataFrame, runs: DataFrame, accepting: DataFrame, initial) -> DataFrame:
    """As accepted_lassos, all runs as one game, for runs and automata of any size."""
    vertices, arcs = product_arena(clauses, runs)
    good = vertices.join(accepting.select("state").distinct(), "state", "left_semi").filter(F.col("owner") == "Eve").select("v")
    home = vertices.filter("pos is null").select("v")
    region = games.buchi_region(vertices.select("v", "owner"), arcs, good.unionByName(home), "Eve")
    starts = runs.groupBy("run_id").agg(F.min("pos").alias("pos"))
    won = region.select("v.run_id", "v.pos", "v.state", "v.clause").filter((F.col("state") == initial) & F.col("clause").isNull()).select("run_id", "pos").withColumn("won", F.lit(True))
    return starts.join(won, ["run_id", "pos"], "left").select("run_id", F.coalesce("won", F.lit(False)).alias("accepted"))


def states_reached(transitions: DataFrame, runs: DataFrame, initial) -> DataFrame:
    """(run_id, pos, state): states in which a nondeterministic automaton (src, letter, dst) can be when it has read a run's
    letters before pos; the end of the run counts as a place. Rounds follow the longest run."""
    last = runs.groupBy("run_id").agg(F.max("pos").alias("last"))
    read = saved(runs.join(last, "run_id").select("run_id", "pos", "letter", F.coalesce(F.lead("pos").over(W.partitionBy("run_id").orderBy("pos")), F.col("last") + 1).alias("next")))
    steps = saved(transitions.select("src", "letter", "dst").distinct())
    kind = dict(transitions.dtypes)["src"]
    seed = runs.groupBy("run_id").agg(F.min("pos").alias("pos")).withColumn("state", F.lit(initial).cast(kind))
    on = lambda new, _: new.join(read, ["run_id", "pos"]).withColumnRenamed("state", "src").join(steps, ["src", "letter"]).select("run_id", F.col("next").alias("pos"), F.col("dst").alias("state"))
    return grow(seed, on, ["run_id", "pos", "state"])


def accepted_words(transitions: DataFrame, runs: DataFrame, accepting: DataFrame, initial) -> DataFrame:
    """(run_id, accepted): whether some way through all letters of the run, taken as a finite word, ends in an accepting
    state (state)."""
    ends = runs.groupBy("run_id").agg((F.max("pos") + 1).alias("pos"))
    good = states_reached(transitions, runs, initial).join(accepting.select("state").distinct(), "state", "left_semi")
    good = good.select("run_id", "pos").distinct().withColumn("good", F.lit(True))
    return ends.join(good, ["run_id", "pos"], "left").select("run_id", F.coalesce("good", F.lit(False)).alias("accepted"))
