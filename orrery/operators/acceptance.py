"""Acceptance of runs (run_id, pos, state, in_cycle) by what they visit infinitely often: one aggregation each.

Every run_id gives one row, runs without a cycle too (they visit nothing infinitely often); a null run_id is a run as
well. A null state belongs to no set and has no priority. No runs, no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def infinitely_often(runs: DataFrame) -> DataFrame:
    return runs.filter("in_cycle").select("run_id", "state").distinct()


def finitely_often(runs: DataFrame) -> DataFrame:
    """States of the stem that the cycle does not have."""
    return runs.filter("not in_cycle").select("run_id", "state").distinct().join(infinitely_often(runs), ["run_id", "state"], "left_anti")


def infinitely_often_transitions(runs: DataFrame) -> DataFrame:
    """(run_id, src, dst): steps that the endlessly repeated cycle takes, from its last state to its first as well."""
    cycle = runs.filter("in_cycle")
    last = W.partitionBy("run_id").orderBy("pos")
    first = F.first("state").over(last)
    return cycle.select("run_id", F.col("state").alias("src"), F.coalesce(F.lead("state").over(last), first).alias("dst")).distinct()


def buchi_transitions(runs: DataFrame, accepting: DataFrame) -> DataFrame:
    """(run_id, accepted): whether some accepting transition (src, dst) is taken infinitely often."""
    taken = infinitely_often_transitions(runs).join(accepting.select("src", "dst").distinct().withColumn("hit", F.lit(True)), ["src", "dst"], "left")
    hits = taken.groupBy("run_id").agg(F.bool_or(F.col("hit").isNotNull()).alias("accepted"))
    return runs.select("run_id").distinct().join(hits, "run_id", "left").fillna(False, ["accepted"])


def terminal(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(F.max_by("state", "pos").alias("state"))


def first_seen(runs: DataFrame) -> DataFrame:
    """(run_id, state, pos): each state once, where it comes first."""
    return runs.groupBy("run_id", "state").agg(F.min("pos").alias("pos"))


def unroll(runs: DataFrame, k: int) -> DataFrame:
    """(run_id, step, state): the first k steps of stem and endlessly repeated cycle. A run without cycle ends."""
    size = runs.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("in_cycle").alias("c"))
    steps = size.select("run_id", "n", "c", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("step"))
    at = F.when(F.col("step") < F.col("n"), F.col("step")).when(F.col("c") > 0, F.col("n") - F.col("c") + (F.col("step") - F.col("n")) % F.col("c"))
    return steps.withColumn("pos", at.cast("long")).join(runs.select("run_id", "pos", "state"), ["run_id", "pos"]).select("run_id", F.col("step").cast("long").alias("step"), "state")


def _isin(states: list[str]) -> Column:
    return F.col("state").isin(states) if states else F.lit(False)


def _decide(runs: DataFrame, accepts: Column) -> DataFrame:
    """accepts is an aggregate over a run's cycle rows; other rows carry a null state."""
    return runs.withColumn("state", F.when(F.col("in_cycle"), F.col("state"))).groupBy("run_id").agg(F.coalesce(accepts, F.lit(False)).alias("accepted"))


def visits(states: list[str]) -> Column:
    return F.coalesce(F.bool_or(_isin(states)), F.lit(False))


def final(runs: DataFrame, accepting: list[str]) -> DataFrame:
    return terminal(runs).select("run_id", _isin(accepting).alias("accepted"))


def buchi(runs: DataFrame, accepting: list[str]) -> DataFrame:
    return _decide(runs, visits(accepting))


def co_buchi(runs: DataFrame, rejecting: list[str]) -> DataFrame:
    return _decide(runs, ~visits(rejecting))


def muller(runs: DataFrame, families: list[list[str]]) -> DataFrame:
    seen = F.array_sort(F.collect_set("state"))
    same = F.lit(False)
    for family in families:
        same = same | (seen == F.array(*[F.lit(s) for s in sorted(set(family))]).cast("array<string>"))
    return _decide(runs, same)


def rabin(runs: DataFrame, pairs: list[tuple[list[str], list[str]]]) -> DataFrame:
    """pairs (forbidden, required): some pair's forbidden is not, and its required is, visited; no pair rejects."""
    some = F.lit(False)
    for forbidden, required in pairs:
        some = some | (~visits(forbidden) & visits(required))
    return _decide(runs, some)


def streett(runs: DataFrame, pairs: list[tuple[list[str], list[str]]]) -> DataFrame:
    """pairs (trigger, guarantee): every pair's trigger is not, or its guarantee is, visited; no pair accepts."""
    every = F.lit(True)
    for trigger, guarantee in pairs:
        every = every & (~visits(trigger) | visits(guarantee))
    return _decide(runs, every)


def parity(runs: DataFrame, priorities: dict[str, int], least: bool = True, even: bool = True) -> DataFrame:
    """The least (greatest) priority of the cycle is even (odd); a state without priority, or no cycle, rejects."""
    rank = F.lit(None).cast("int")
    for state, value in priorities.items():
        rank = F.when(F.col("state") == state, value).otherwise(rank)
    extreme = F.min(rank) if least else F.max(rank)
    full = (F.count(rank) == F.count("state")) & (F.count("state") > 0)
    return _decide(runs, full & (extreme % 2 == (0 if even else 1)))


def lasso_parts(runs: DataFrame) -> DataFrame:
    """(run_id, stem, cycle, cycle_index): the states before the cycle and on it, in order, and the cycle's first place; null
    without a cycle. A run is one row."""
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "state")))), lambda x: x["state"])
    return runs.groupBy("run_id").agg(listed(~F.col("in_cycle")).alias("stem"), listed(F.col("in_cycle")).alias("cycle"), F.min(F.when(F.col("in_cycle"), F.col("pos"))).alias("cycle_index"))
