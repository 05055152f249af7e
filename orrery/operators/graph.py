"""Lookups, degrees, positional access and edits of graphs given as vertices (v) and arcs (e, src, dst).

Null endpoints are vertices of their own where rows are grouped, and meet nothing where rows are joined. Empty tables
give empty results (counts of 0 where one row is promised). Repeated arc rows are parallel arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.sources.graphs import numbered


def degrees(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """(v, outgoing, incoming, loops) with multiplicity; 0 for vertices without arcs. One pass over the arcs."""
    ends = arcs.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i"), (F.col("src") == F.col("dst")).cast("int").alias("l")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("l")))).alias("x")).select("x.*")
    counts = ends.groupBy("v").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.sum("l").alias("loops"))
    return vertices.select("v").join(counts, "v", "left").fillna(0, ["outgoing", "incoming", "loops"])


def undirected_degrees(edges: DataFrame) -> DataFrame:
    """(v, degree): a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count("*").alias("degree"))


def outgoing(arcs: DataFrame, v: int) -> DataFrame:
    return arcs.filter(F.col("src") == v)


def incoming(arcs: DataFrame, v: int) -> DataFrame:
    return arcs.filter(F.col("dst") == v)


def connections(arcs: DataFrame) -> DataFrame:
    """(src, dst, n): parallel arcs between each connected pair."""
    return arcs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def connected_pairs(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """The pairs (src, dst) that an arc connects."""
    return pairs.join(arcs, ["src", "dst"], "left_semi")


def neighbour_at(arcs: DataFrame, k: int, forward: bool = True) -> DataFrame:
    """(v, neighbour): the k-th (from 0) successor or predecessor in the order of arc ids; no row past the end. Spark
    limits the ranks before the shuffle as well, so of a hot vertex each task sends at most k + 1 arcs."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    place = F.row_number().over(W.partitionBy(near).orderBy("e"))
    return arcs.withColumn("k", place).filter(F.col("k") == k + 1).select(F.col(near).alias("v"), F.col(far).alias("neighbour"))


def neighbour_ranges(arcs: DataFrame) -> DataFrame:
    """(src, first, stop): the ids of a source's arcs are first .. stop - 1."""
    return arcs.groupBy("src").agg(F.min("e").alias("first"), (F.max("e") + 1).alias("stop"))


def reversed_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.withColumnsRenamed({"src": "_src"}).withColumnRenamed("dst", "src").withColumnRenamed("_src", "dst")


def counts(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row (vertices, edges, empty): empty is true without vertices."""
    both = vertices.agg(F.count("*").alias("vertices")).crossJoin(arcs.agg(F.count("*").alias("edges")))
    return both.select("vertices", "edges", (F.col("vertices") == 0).alias("empty"))


def neighbours(arcs: DataFrame, forward: bool = True) -> DataFrame:
    """(v, neighbour): distinct successors (or predecessors) of every vertex."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    return arcs.select(F.col(near).alias("v"), F.col(far).alias("neighbour")).distinct()


def connects_to(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """The pairs (src, dst) with connected: whether an arc leads from src to dst."""
    mark = arcs.select("src", "dst").distinct().withColumn("connected", F.lit(True))
    return pairs.join(mark, ["src", "dst"], "left").fillna(False, ["connected"])


def arc_ranges(arcs: DataFrame, first: int, stop: int) -> DataFrame:
    """The arcs with ids first .. stop - 1."""
    return arcs.filter((F.col("e") >= first) & (F.col("e") < stop))


def insert_arc(arcs: DataFrame, vertices: DataFrame, src: int, dst: int) -> DataFrame:
    """The arc comes last among src's own, later ids shift up; unchanged if an endpoint is missing."""
    both = vertices.filter(F.col("v").isin(src, dst)).agg((F.count_distinct("v") == len({src, dst})).alias("ok"))
    at = arcs.agg(F.coalesce(F.max(F.when(F.col("src") <= src, F.col("e"))) + 1, F.lit(0)).alias("at")).crossJoin(both)
    moved = arcs.crossJoin(F.broadcast(at)).select((F.col("e") + (F.col("ok") & (F.col("e") >= F.col("at"))).cast("long")).alias("e"), "src", "dst")
    return moved.unionByName(at.filter("ok").select(F.col("at").cast("long").alias("e"), F.lit(src).cast("long").alias("src"), F.lit(dst).cast("long").alias("dst")))


def remove_arc(arcs: DataFrame, e: int) -> DataFrame:
    return arcs.filter(F.col("e") != e).withColumn("e", F.col("e") - (F.col("e") > e).cast("long"))


def remove_vertex(arcs: DataFrame, v: int) -> DataFrame:
    """(e, src, dst) without v's arcs; greater vertices move down by one, and the arcs that stay are numbered anew in
    the order of their ids."""
    down: Column = lambda c: F.col(c) - (F.col(c) > v).cast("long")
    kept = arcs.filter((F.col("src") != v) & (F.col("dst") != v)).select(F.col("e").alias("old"), down("src").alias("src"), down("dst").alias("dst"))
    return numbered(kept, ["old"]).select("e", "src", "dst")


def insert_vertex(vertices: DataFrame) -> DataFrame:
    """One more vertex, numbered after the greatest."""
    return vertices.select("v").unionByName(vertices.agg(F.coalesce(F.max("v") + 1, F.lit(0)).cast("long").alias("v")))


def with_properties(rows: DataFrame, properties: DataFrame, key: str) -> DataFrame:
    """Attributes beside vertices or arcs; null where there is none."""
    return rows.join(properties, key, "left")


def incidence(hyperarcs: DataFrame, side: str) -> DataFrame:
    """(v, e): one row for each time that v stands in the side (tail or head)."""
    return hyperarcs.select(F.explode(side).alias("v"), "e")


def hyper_degrees(hyperarcs: DataFrame) -> DataFrame:
    """(v, outgoing, incoming), with multiplicity."""
    ends = incidence(hyperarcs, "tail").select("v", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(incidence(hyperarcs, "head").select("v", F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("v").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def hyper_step(frontier: DataFrame, hyperarcs: DataFrame, forward: bool = True) -> DataFrame:
    """Vertices of the far side of every hyperarc that has some frontier vertex on its near side."""
    near, far = ("tail", "head") if forward else ("head", "tail")
    touched = incidence(hyperarcs, near).join(frontier.select("v"), "v", "left_semi").select("e").distinct()
    return hyperarcs.join(touched, "e", "left_semi").select(F.explode(far).alias("v")).distinct()


def hyper_cardinalities(hyperarcs: DataFrame) -> DataFrame:
    """(e, tail_size, head_size), with multiplicity."""
    return hyperarcs.select("e", F.size("tail").alias("tail_size"), F.size("head").alias("head_size"))


def hyper_contains(hyperarcs: DataFrame, v: int) -> DataFrame:
    """(e, in_tail, in_head): where v stands in each hyperarc."""
    return hyperarcs.select("e", F.array_contains("tail", v).alias("in_tail"), F.array_contains("head", v).alias("in_head"))


def hyper_arcs_between(hyperarcs: DataFrame, u: int, v: int) -> DataFrame:
    """(e): the hyperarcs from u, in the tail, to v, in the head."""
    return hyperarcs.filter(F.array_contains("tail", u) & F.array_contains("head", v)).select("e")


def side_counts(sides: DataFrame) -> DataFrame:
    """(side, vertices)."""
    return sides.groupBy("side").agg(F.count("*").alias("vertices"))


def same_side(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """The pairs (src, dst) with same: whether both lie on one side; null if one has none."""
    a, b = sides.select(F.col("v").alias("src"), F.col("side").alias("_s")), sides.select(F.col("v").alias("dst"), F.col("side").alias("_d"))
    return pairs.join(a, "src", "left").join(b, "dst", "left").withColumn("same", F.col("_s") == F.col("_d")).drop("_s", "_d")


def insert_on_side(sides: DataFrame, side) -> DataFrame:
    """One more vertex without arcs, numbered after the greatest, on the given side (or of the given colour)."""
    kind = sides.schema["side"].dataType
    return sides.select("v", "side").unionByName(sides.agg(F.coalesce(F.max("v") + 1, F.lit(0)).cast("long").alias("v"), F.lit(side).cast(kind).alias("side")))


def insert_crossing(arcs: DataFrame, sides: DataFrame, src: int, dst: int) -> DataFrame:
    """insert_arc where the endpoints lie on different sides; unchanged where they don't or one has none."""
    ends = sides.filter(F.col("v").isin(src, dst))
    crossing = ends.agg((F.count_distinct("side") == 2).alias("ok")).filter("ok")
    return insert_arc(arcs, ends.crossJoin(F.broadcast(crossing)).select("v"), src, dst)


def move_to_side(sides: DataFrame, arcs: DataFrame, v: int, side) -> DataFrame:
    """v on the side, if that leaves all of its arcs crossing; unchanged if not, or if there is no v."""
    others = arcs.filter(F.col("src") == v).select(F.col("dst").alias("v")).unionByName(arcs.filter(F.col("dst") == v).select(F.col("src").alias("v"))).distinct()
    bad = others.join(sides, "v").agg((F.count_if(F.col("side") == side) > 0).alias("bad"))
    move = (F.col("v") == v) & ~F.col("bad")
    kind = sides.schema["side"].dataType
    return sides.crossJoin(F.broadcast(bad)).select("v", F.when(move, F.lit(side).cast(kind)).otherwise(F.col("side")).alias("side"))


def recolour(colours: DataFrame, v: int, colour, column: str = "colour") -> DataFrame:
    """v with the colour; nothing changes if there is no v."""
    return colours.withColumn(column, F.when(F.col("v") == v, F.lit(colour)).otherwise(F.col(column)))


def crossing_violations(arcs: DataFrame, sides: DataFrame) -> DataFrame:
    """Arcs that don't cross between the sides (v, side), or whose endpoint has no side."""
    a, b = sides.select(F.col("v").alias("src"), F.col("side").alias("s")), sides.select(F.col("v").alias("dst"), F.col("side").alias("d"))
    return arcs.join(a, "src", "left").join(b, "dst", "left").filter(~F.coalesce(F.col("s") != F.col("d"), F.lit(False))).select("e", "src", "dst")


def can_change_side(arcs: DataFrame, sides: DataFrame) -> DataFrame:
    """(v, feasible): whether v could move to the other side: only without arcs, as all of them cross now."""
    touched = arcs.select(F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("touched", F.lit(True))
    return sides.join(touched, "v", "left").select("v", F.col("touched").isNull().alias("feasible"))


def step(frontier: DataFrame, arcs: DataFrame, forward: bool = True) -> DataFrame:
    """Bag of successors (or predecessors): one row for each arc from a frontier row."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    return frontier.select(F.col("v").alias(near)).join(arcs.select(near, far), near).select(F.col(far).alias("v"))


def under_letter(transitions: DataFrame, letter: str) -> DataFrame:
    return transitions.filter(F.col("letter") == letter)


def incoming_under_letter(transitions: DataFrame, letter: str) -> DataFrame:
    """(v, pred): one row for each transition into v under the letter."""
    return under_letter(transitions, letter).select(F.col("dst").alias("v"), F.col("src").alias("pred"))


def alphabet(transitions: DataFrame, column: str = "letter") -> DataFrame:
    """(letter): the distinct letters, or input or output symbols, in use."""
    return transitions.select(F.col(column).alias("letter")).distinct()


def relation_size(transitions: DataFrame) -> DataFrame:
    """One row (states, transitions, letters): states are the transitions' endpoints."""
    states = transitions.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.count_distinct("v").alias("states"))
    return states.crossJoin(transitions.agg(F.count("*").alias("transitions"), F.count_distinct("letter").alias("letters")))
