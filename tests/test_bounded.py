"""Graphs that fit one task are finished in few tables; the same rows come by rounds and where rounds leave a rest that fits."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import bounded, reach
from orrery.plans import fixpoint


def graph(seed):
    rng = random.Random(seed)
    arcs = [(rng.randrange(-9, 30), rng.randrange(-9, 30)) for _ in range(50)]
    return arcs + [(i, i + 1) for i in range(30, 60)] + [(60, 45), (3, 30), (7, 7), (None, 2), (2, None), arcs[0]]


def tables(monkeypatch):
    made, keep = [], fixpoint.written
    monkeypatch.setattr(fixpoint, "written", lambda *a: made.append(1) or keep(*a))
    return made


@pytest.mark.parametrize("words", [250])
def test_rounds_and_one_task_give_the_same(spark, monkeypatch, words):
    arcs = spark.createDataFrame(graph(words), "src long, dst long")
    vertices = arcs.select(F.col("src").alias("v")).unionByName(spark.range(-20, 50).toDF("v"))
    start, accepting = spark.createDataFrame([(3,), (999,), (None,)], "v long"), spark.range(0, 60, 5).toDF("v")
    ranks = spark.range(-9, 61).select(F.col("id").alias("v"), F.pmod(F.col("id") * 7, F.lit(5)).alias("priority"))

    def found():
        classes = fixpoint.saved(reach.components(vertices, arcs))
        parts = [classes, reach.reached(arcs, start).filter("v is not null"), reach.buchi_nonempty(arcs, start, accepting), reach.parity_nonempty(arcs, start, ranks), reach.class_order(classes, arcs)]
        return [sorted(map(tuple, p.collect())) for p in parts]

    whole = found()
    assert len({c for _, c in whole[0]}) > 20 and whole[2] and whole[3]
    monkeypatch.setattr(bounded, "WORDS", words)
    assert found() == whole


def test_many_components_take_few_tables(spark, monkeypatch):
    made = tables(monkeypatch)
    n = 400
    arcs = spark.range(4 * n).select((F.col("id") % n).alias("src"), F.when(F.col("id") % 4 == 0, F.col("id") % n - F.col("id") % n % 50).otherwise(F.least(F.col("id") % n + 1 + F.col("id") * 7919 % 40, F.lit(n - 1))).alias("dst"))
    classes = reach.components(spark.range(n).toDF("v"), arcs)
    assert classes.select("class").distinct().count() > 5 and len(made) < 8
    assert reach.class_order(fixpoint.saved(classes), arcs).count() > 5 and len(made) < 16


def test_no_arc_and_no_vertex(spark):
    arcs = spark.createDataFrame([], "src long, dst long")
    assert sorted(map(tuple, reach.components(spark.range(3).toDF("v"), arcs).collect())) == [(0, 0), (1, 1), (2, 2)]
    assert [r.v for r in reach.reached(arcs, spark.range(4, 5).toDF("v")).collect()] == [4]
    assert reach.buchi_nonempty(arcs, spark.range(1).toDF("v"), spark.range(1).toDF("v")).count() == 0
    assert reach.reached(arcs, spark.range(0).toDF("v")).count() == 0
