"""Graphs from tables: arcs (e, src, dst), vertices (v), hyperarcs (e, tail, head), labelled transitions and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans.fixpoint import saved


def numbered(rows: DataFrame, order: list[str], name: str = "e") -> DataFrame:
    """rows with 0, 1, ... in the given order, nulls first, in a column called name; equal rows are numbered somehow.

    Rows are dealt by ranges of the order and a drawn number, so no value that has a third of all rows is one task's
    work; only the ranges' sizes, one number each, are added up in one place."""
    by = [*order, "_spread"]
    dealt = rows.withColumn("_spread", F.rand(1)).repartitionByRange(*by).sortWithinPartitions(*by).drop("_spread")
    # The id holds the range's number and, in its lower 33 bits, the place inside; both are fixed once written.
    placed = saved(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    begins = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_begin"))
    place = F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(begins), "_range").select(place.alias(name), *rows.columns)


def numbered_arcs(arcs: DataFrame) -> DataFrame:
    """Multigraph layout (e, src, dst): parallel arcs and loops stay; ids are 0, 1, ... in the order of (src, dst), null
    endpoints first. Other columns are left aside; no arcs, no rows."""
    return numbered(arcs.select("src", "dst"), ["src", "dst"])


def vertex_range(arcs: DataFrame) -> DataFrame:
    """0 .. greatest endpoint, gaps included as isolated vertices; no arc, no vertex. Null endpoints don't count."""
    top = arcs.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return arcs.sparkSession.range(0, 0 if top is None else top + 1).toDF("v")


def simple_arcs(arcs: DataFrame) -> DataFrame:
    """The simple graph of a multigraph."""
    return arcs.select("src", "dst").distinct()


def complete_arcs(spark, n: int) -> DataFrame:
    """All n * n arcs, loops included."""
    return spark.range(n * n).select((F.col("id") / n).cast("long").alias("src"), (F.col("id") % n).alias("dst"))


def from_arcs_and_sides(arcs: DataFrame, sides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A two-sided graph of arcs (src, dst) and sides (v, side): its vertices (v, side), one for each side entry, its
    arcs (src, dst) that cross, and the refused arcs, which stay on one side or end at a vertex without a side."""
    a, b = sides.select(F.col("v").alias("src"), F.col("side").alias("_s")), sides.select(F.col("v").alias("dst"), F.col("side").alias("_d"))
    marked = arcs.join(a, "src", "left").join(b, "dst", "left").withColumn("_ok", F.coalesce(F.col("_s") != F.col("_d"), F.lit(False)))
    marked = marked.select("src", "dst", "_ok")
    return sides.select("v", "side"), marked.filter("_ok").drop("_ok"), marked.filter("not _ok").drop("_ok")


def hyperarcs(rows: DataFrame, key: str, tail: str, head: str) -> DataFrame:
    """One hyperarc for each key; repeated members stay, in the order of their values."""
    return rows.groupBy(F.col(key).alias("e")).agg(F.array_sort(F.collect_list(tail)).alias("tail"), F.array_sort(F.collect_list(head)).alias("head"))


def order_arcs(spark, sf_dir: str) -> DataFrame:
    """Every order as an arc between customers: (o, src, dst, letter)."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    n = customers.agg(F.count("*").alias("n"))
    return orders.crossJoin(F.broadcast(n)).select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7 % F.col("n")).alias("dst"), F.substring("o_orderpriority", 1, 1).alias("letter"))


def layered_arcs(spark, sf_dir: str) -> DataFrame:
    """Every order as an arc (e, src, dst) from its customer: back to the first of the customer's block (an eighth of all
    customers), one or two on, or some way on, by the order's key. Components lie inside blocks; between these there is no way back."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    n = customers.agg(F.count("*").alias("n"))
    o, src, last = F.col("o_orderkey"), F.col("o_custkey"), F.col("n") - 1
    dst = F.when(o % 4 == 0, src - src % F.greatest(F.floor(F.col("n") / 8), F.lit(1))).when(o % 4 == 1, F.least(src + 1 + F.floor(o / 4) % 2, last)).otherwise(F.least(src + 1 + o * 7919 % F.greatest(F.floor(F.col("n") / 10), F.lit(1)), last))
    return orders.crossJoin(F.broadcast(n)).select(o.alias("e"), src.alias("src"), dst.alias("dst"))


def customer_arena(spark, sf_dir: str) -> DataFrame:
    """(v, owner, balance): a customer with an even key belongs to Eve, the others to Adam."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("v"), F.when(F.col("c_custkey") % 2 == 0, "Eve").otherwise("Adam").alias("owner"), F.col("c_acctbal").alias("balance"))


def user_runs(spark, sf_dir: str) -> DataFrame:
    """Lasso runs of event types: (run_id, pos, state, in_cycle). A user's events in order of time are cut into runs of
    3 to 8 (by the user), the last one shorter; a run's last 1 to 3 events are its cycle."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    size = 3 + F.col("user_id") % 6
    cut = events.select("user_id", F.col("event_type").alias("state"), place.cast("long").alias("place"))
    rows = cut.select((F.col("user_id") * 1000000 + F.floor(F.col("place") / size)).alias("run_id"), (F.col("place") % size).alias("pos"), "state")
    n = F.count("*").over(W.partitionBy("run_id"))
    return rows.withColumn("n", n).select("run_id", "pos", "state", (F.col("pos") >= F.col("n") - 1 - F.col("run_id") % 3).alias("in_cycle"))
