"""Plays are followed inside tasks and written to no table of rounds; large strategies, joined with themselves, give the same."""

import random

import pytest

from orrery.operators import games
from orrery.plans import fixpoint


def walk(start, choice):
    seen = [start]
    while len(set(seen)) == len(seen) and seen[-1] in choice:
        seen.append(choice[seen[-1]])
    return [(start, pos, v) for pos, v in enumerate(seen)]


@pytest.mark.parametrize("sent", [games.SENT, 0])
def test_plays_are_walks(spark, monkeypatch, sent):
    rng = random.Random(5)
    choice = {v: rng.randrange(120) for v in range(100) if rng.random() < 0.9} | {7: None, 8: 7, 200: 200}
    starts = [*range(0, 130, 2), 200, 999, 8, 8]
    monkeypatch.setattr(games, "SENT", sent)
    monkeypatch.setattr(games, "HELD_ROWS", 50)
    strategy = spark.createDataFrame(list(choice.items()), "v long, succ long")
    found = games.plays(spark.createDataFrame([(v,) for v in [*starts, None]], "v long"), strategy)
    want = [row for v in set(starts) for row in walk(v, choice)]
    key = lambda row: row[:2]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_long_plays_are_not_written_for_steps(spark, monkeypatch):
    rows, keep = [], fixpoint.written
    monkeypatch.setattr(fixpoint, "written", lambda *a: rows.append((out := keep(*a)).count()) or out)
    circle = spark.range(300).selectExpr("id as v", "(id + 1) % 300 as succ")
    assert games.plays(circle.select("v"), circle).count() == 300 * 301
    assert max(rows) <= 600
