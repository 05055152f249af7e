"""Undirected hypergraphs (e, members), property stores (k, property) and clause views of transition relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hyperedges(rows: DataFrame, key: str, member: str) -> DataFrame:
    """One undirected hyperedge for each key; repeated members stay, in the order of their values."""
    return rows.groupBy(F.col(key).alias("e")).agg(F.array_sort(F.collect_list(member)).alias("members"))


def incident(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, e): the hyperedges of each of the vertices (v), once each."""
    ends = edges.select(F.explode(F.array_distinct("members")).alias("v"), "e")
    return ends.join(vertices.select("v").distinct(), "v", "left_semi")


def hyper_connections(edges: DataFrame, u: int, v: int) -> DataFrame:
    """(e): the hyperedges that hold both vertices; for u = v, those that hold it."""
    return edges.filter(F.array_contains("members", u) & F.array_contains("members", v)).select("e")


def set_property(store: DataFrame, k: int, value) -> DataFrame:
    """The value replaces the one under k; nothing changes where k is absent."""
    return store.select("k", F.when(F.col("k") == k, F.lit(value)).otherwise(F.col("property")).alias("property"))


def insert_property(store: DataFrame, k: int, value) -> DataFrame:
    """Keys from k on move up by one; unchanged if k is greater than the number of entries (keys are 0 .. n - 1)."""
    fits = store.agg((F.count("*") >= k).alias("fits"))
    moved = store.crossJoin(F.broadcast(fits)).select((F.col("k") + (F.col("fits") & (F.col("k") >= k)).cast("long")).alias("k"), "property")
    kind = store.schema["property"].dataType
    return moved.unionByName(fits.filter("fits").select(F.lit(k).cast("long").alias("k"), F.lit(value).cast(kind).alias("property")))


def remove_property(store: DataFrame, k: int) -> DataFrame:
    """Without the entry under k; greater keys move down by one."""
    return store.filter(F.col("k") != k).select((F.col("k") - (F.col("k") > k).cast("long")).alias("k"), "property")


def clauses(transitions: DataFrame) -> DataFrame:
    """(state, letter, clause, succ): a nondeterministic relation as an alternating one, each transition a clause of
    one successor."""
    return transitions.select(F.col("src").alias("state"), "letter", F.col("e").alias("clause"), F.col("dst").alias("succ"))


def conjunctive_clauses(transitions: DataFrame, clause: str) -> DataFrame:
    """(state, letter, clause, succ): transitions of one state and letter that share the value of a column are one
    clause, all of whose successors must accept."""
    return transitions.select(F.col("src").alias("state"), "letter", F.col(clause).alias("clause"), F.col("dst").alias("succ")).distinct()


def clause_satisfied(clauses: DataFrame, good: DataFrame) -> DataFrame:
    """(state, letter): those with some clause all of whose successors are good (v)."""
    mark = good.select(F.col("v").alias("succ")).distinct().withColumn("_good", F.lit(True))
    whole = clauses.join(mark, "succ", "left").groupBy("state", "letter", "clause").agg(F.every(F.col("_good").isNotNull()).alias("ok"))
    return whole.filter("ok").select("state", "letter").distinct()


def clause_sets(clauses: DataFrame) -> DataFrame:
    """(state, letter, clause, successors): each clause's conjunction as a sorted set."""
    return clauses.groupBy("state", "letter", "clause").agg(F.array_sort(F.collect_set("succ")).alias("successors"))
