"""Bands: consecutive positions first .. stop - 1 that belong to one key, and which band a position is in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans.fixpoint import saved

#: Positions of a bin, so many rows of one task's group at most.
WIDTH = 4096


def in_order(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """rows with first and stop: each takes `size` positions (null: none) behind those before it in the given order, which
    must tell rows apart. Rows are dealt by ranges; only the ranges' sums are added up in one place."""
    sized = F.coalesce(F.col(size), F.lit(0)).cast("long")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = saved(dealt).withColumn("_range", F.shiftright("_at", 33))
    sums = placed.groupBy("_range").agg(F.sum(sized).alias("_sum"))
    begins = sums.select("_range", (F.sum("_sum").over(W.orderBy("_range")) - F.col("_sum")).alias("_begin"))
    before = F.sum(sized).over(W.partitionBy("_range").orderBy("_at")) - sized
    out = placed.withColumn("_before", before).join(F.broadcast(begins), "_range")
    return out.withColumn("first", F.col("_begin") + F.col("_before")).withColumn("stop", F.col("first") + sized).select(*rows.columns, "first", "stop")


def lookup(positions: DataFrame, bands: DataFrame, position: str, width: int = WIDTH) -> DataFrame:
    """positions joined with the band (first, stop and its other columns) that each lies in; those in none are left out.

    Both sides meet by bins of `width` positions: a band is listed once for each bin it touches, so bins hold at most
    `width` non-empty bands that do not overlap, and no position meets all bands."""
    touched = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("stop") - 1) / width))).alias("_bin")
    listed = bands.filter("stop > first").select("*", touched)
    rows = positions.withColumn("_bin", F.floor(F.col(position) / width))
    inside = (F.col(position) >= F.col("first")) & (F.col(position) < F.col("stop"))
    return rows.join(listed, "_bin").filter(inside).drop("_bin")
