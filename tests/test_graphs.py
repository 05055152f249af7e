"""Components, plays, numbering and two-sided edits against brute force, with nulls, repeats and empty tables."""

import random

import pytest

from orrery.operators import games, graph, reach
from orrery.sources import graphs


def brute_components(vertices, arcs):
    ahead = {v: {b for a, b in arcs if a == v and b in vertices} for v in vertices}

    def reached(v):
        seen, todo = {v}, [v]
        while todo:
            for b in ahead[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    far = {v: reached(v) for v in vertices}
    return {v: min(w for w in far[v] if v in far[w]) for v in vertices}


def frame(spark, arcs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(arcs)], "e long, src long, dst long")


def ids(spark, vertices):
    return spark.createDataFrame([(v,) for v in vertices], "v long")


def random_graph(seed):
    rng = random.Random(seed)
    n = 40
    arcs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([25, 45, 70]))]
    # Chains and circles with branches, and a repeated arc.
    arcs += [(i, i + 1) for i in range(n, n + 12)] + [(n + 12, n + 5), (3, n), (n + 9, 4), arcs[0]]
    arcs += [(60, 61), (61, 62), (62, 60), (59, 60)]
    return set(range(63)), arcs


@pytest.mark.parametrize("seed", range(3))
def test_components_are_brute_force(spark, seed):
    vertices, arcs = random_graph(seed)
    rows = reach.components(ids(spark, [*vertices, 5, None]), frame(spark, [*arcs, (None, 3), (2, 999)])).collect()
    assert sorted((r.v, r["class"]) for r in rows) == sorted(brute_components(vertices, arcs).items())


def test_components_of_nothing(spark):
    assert reach.components(ids(spark, []), frame(spark, [])).count() == 0


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    keep = reach.saved
    monkeypatch.setattr(reach, "saved", lambda df: written.append(1) or keep(df))
    n = 10_000
    arcs = spark.range(n - 1).selectExpr("id as e", "id as src", "id + 1 as dst")
    assert reach.components(spark.range(n).toDF("v"), arcs).filter("v = class").count() == n
    assert len(written) < 80


def test_plays_follow_the_strategy(spark):
    choice = {1: 2, 2: 3, 3: 1, 4: 5, 5: 6, 7: 7}
    strategy = spark.createDataFrame(list(choice.items()), "v long, succ long")
    got = {}
    for r in games.plays(ids(spark, [1, 4, 6, 7, 7, None]), strategy).collect():
        got.setdefault(r.start, {})[r.pos] = r.v
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {1: [1, 2, 3, 1], 4: [4, 5, 6], 6: [6], 7: [7, 7]}
    assert games.play(4, strategy) == [4, 5, 6]
    assert games.plays(ids(spark, []), strategy).count() == 0


def test_numbering_keeps_nulls_and_parallel_arcs(spark):
    rows = graphs.numbered_arcs(frame(spark, [(2, 1), (None, 5), (1, 1), (1, 1), (1, None)])).collect()
    assert [(r.src, r.dst) for r in sorted(rows, key=lambda r: r.e)] == [(None, 5), (1, None), (1, 1), (1, 1), (2, 1)]
    assert sorted(r.e for r in rows) == list(range(5))
    assert graphs.vertex_range(frame(spark, [])).count() == 0
    assert graphs.vertex_range(frame(spark, [(2, 1), (None, 7)])).count() == 8


def test_remove_vertex_numbers_anew(spark):
    rows = graph.remove_vertex(frame(spark, [(0, 1), (1, 2), (2, 3), (3, 0)]), 1).collect()
    assert sorted((r.e, r.src, r.dst) for r in rows) == [(0, 1, 2), (1, 2, 0)]


def test_two_sided_edits(spark):
    sides = spark.createDataFrame([(0, False), (1, True), (2, False)], "v long, side boolean")
    arcs = frame(spark, [(0, 1)])
    of = lambda df: {r.v: r.side for r in df.collect()}
    assert of(graph.move_to_side(sides, arcs, 0, True)) == of(sides)
    assert of(graph.move_to_side(sides, arcs, 2, True))[2] is True
    assert of(graph.move_to_side(sides, arcs, 9, True)) == of(sides)
    assert graph.insert_crossing(arcs, sides, 1, 2).count() == 2
    assert graph.insert_crossing(arcs, sides, 0, 2).count() == 1
    assert graph.insert_crossing(arcs, sides, 0, 9).count() == 1
    kept, taken, refused = graphs.from_arcs_and_sides(frame(spark, [(0, 1), (0, 2), (1, 7), (None, 1)]), sides)
    assert (kept.count(), taken.count(), refused.count()) == (3, 1, 3)


def test_tables_of_steps_can_be_deleted(spark):
    from orrery.plans import fixpoint

    before = fixpoint.clearings(spark)
    table = fixpoint.saved(spark.range(3).toDF("v"))
    assert table.count() == 3 and fixpoint.clear(spark) > 0 and fixpoint.clear(spark) == 0
    assert fixpoint.clearings(spark) == before + 2
    with pytest.raises(Exception, match="(?i)does not exist|not found|no such file"):
        table.collect()
    # What settles keeps its last round only.
    state = spark.createDataFrame([(i, 20 - i) for i in range(20)], "v long, n long")
    done = fixpoint.settle(state, lambda s: s.select("v", ((s["n"] + 1) / 2).cast("long").alias("n")), "v", "n")
    assert {r.n for r in done.collect()} == {1} and fixpoint.clear(spark) == 1
