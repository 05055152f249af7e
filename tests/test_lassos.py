"""Lassos are solved inside tasks, and as the arena of all of them solves them."""

import random

from orrery.operators import alternating
from orrery.plans import fixpoint


def test_runs_are_solved_without_rounds_as_in_the_arena(spark, monkeypatch):
    made, keep = [], fixpoint.written
    monkeypatch.setattr(fixpoint, "written", lambda *a: made.append(1) or keep(*a))
    rng = random.Random(3)
    clauses = [(rng.randrange(6), rng.choice("ab"), i, rng.randrange(6)) for i in list(range(14)) * 2] + [(5, "b", 99, None)]
    runs = [(r, p, rng.choice("aab") if rng.random() < 0.98 else None, p >= n - r % 4) for r in range(150) for n in [1 + r % 9] for p in range(n)]
    frames = spark.createDataFrame(clauses, "state long, letter string, clause long, succ long"), spark.createDataFrame(runs, "run_id long, pos long, letter string, in_cycle boolean"), spark.createDataFrame([(1,), (4,)], "state long")
    got = sorted(map(tuple, alternating.accepted_lassos(*frames, 0).collect()))
    assert len(made) <= 2 and len({x for _, x in got}) == 2
    assert got == sorted(map(tuple, alternating.accepted_in_arena(*frames, 0).collect()))
    monkeypatch.setattr(alternating, "PLACES", 3)
    asked = []
    monkeypatch.setattr(alternating, "accepted_in_arena", lambda *a: asked.append(a))
    alternating.accepted_lassos(*frames, 0)
    assert asked
