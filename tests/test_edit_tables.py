"""Bulk edits keep one table of arcs, whatever the number of chunks."""

from pyspark.sql import functions as F

from orrery.operators import edits
from orrery.plans import fixpoint


def test_arcs_before_a_chunk_go(spark):
    fixpoint.clear(spark)
    arcs = spark.range(40).select(F.col("id").alias("e"), F.floor(F.col("id") / 4).alias("src"), (F.col("id") % 4).alias("dst"))
    made = spark.range(30).select(F.col("id").alias("t"), F.lit("remove").alias("kind"), F.lit(1).cast("long").alias("e"), F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"))
    left = edits.edited(arcs, made, 10, chunk=5)
    assert sorted((r.e, r.src, r.dst) for r in left.collect()) == [(0, 0, 0)] + [(i, (i + 30) // 4, (i + 30) % 4) for i in range(1, 10)]
    assert fixpoint.clear(spark) <= 3
