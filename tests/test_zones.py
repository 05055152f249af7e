"""Zone closure against brute force: empty zones, sums out of range, null zones."""

import random

from pyspark.sql import functions as F

from orrery.functions import zones

INF = zones.INFINITY


def add(a, b):
    if INF in (a, b):
        return INF
    raw = ((a >> 1) + (b >> 1)) * 2 + (a & b & 1)
    if not -32768 <= raw < INF:
        raise OverflowError
    return raw


def closed(m, n):
    m = [list(r) for r in m]
    for i in range(n):
        m[i][i] = min(m[i][i], 1)
    for k in range(n):
        m = [[min(m[i][j], add(m[i][k], m[k][j])) for j in range(n)] for i in range(n)]
    return [x for r in m for x in r]


def random_zone(rng, n, wide):
    return [[rng.choice([INF, rng.randint(-wide, wide)]) for _ in range(n)] for _ in range(n)]


def test_closure_is_brute_force(spark):
    rng = random.Random(4)
    n, rows, want = 4, [], {}
    for i in range(300):
        m = random_zone(rng, n, rng.choice([60, 9000, 30000]))
        try:
            want[i] = (closed(m, n), False)
        except OverflowError:
            want[i] = (None, True)
        rows.append((i, [x for r in m for x in r], "kept"))
    rows.append((300, None, "kept"))
    want[300] = (None, False)
    df = spark.createDataFrame(rows, "k int, zone array<int>, _closed string")
    got = {r.k: (r.zone, r.overflow) for r in zones.closed(df, n).collect()}
    assert got == want and {o for _, o in want.values()} == {True, False}
    empty = [z for z, _ in want.values() if z and min(z[i * (n + 1)] for i in range(n)) < 1]
    assert len(empty) > 20
    ok = zones.closed(df, n).filter(zones.is_consistent(F.col("zone"), n)).count()
    assert ok == sum(z is not None for z, _ in want.values()) - len(empty)
    assert zones.closed(df.filter("false"), n).count() == 0


def test_closing_one_pair_finds_contradictions(spark):
    rng = random.Random(8)
    n, rows, want = 3, [], {}
    while len(rows) < 200:
        m = random_zone(rng, n, 60)
        z = closed(m, n)
        if min(z[i * (n + 1)] for i in range(n)) < 1:
            continue
        tight = list(z)
        tight[1 * n + 2] = min(tight[1 * n + 2], rng.randint(-80, 20))
        again = closed([tight[i * n : i * n + n] for i in range(n)], n)
        want[len(rows)] = min(again[i * (n + 1)] for i in range(n)) >= 1, again
        rows.append((len(rows), tight))
    df = zones.closed_pair(spark.createDataFrame(rows, "k int, zone array<int>"), 1, 2, n)
    seen = set()
    for r in df.withColumn("ok", zones.is_consistent(F.col("zone"), n)).collect():
        ok, cells = want[r.k]
        assert r.ok == ok and (not ok or r.zone == cells)
        seen.add(ok)
    assert seen == {True, False}


def test_arithmetic_tells_failures(spark):
    rows = [(2 * 10000 + 1, 2 * 10000 + 1), (7, INF), (7, 5), (None, 5)]
    df = spark.createDataFrame(rows, "a int, b int")
    total, minus = zones.add(F.col("a"), F.col("b")), zones.subtract(F.col("a"), F.col("b"))
    got = [tuple(r) for r in df.select(total, zones.failed(total, F.col("a"), F.col("b")), minus, zones.failed(minus, F.col("a"), F.col("b"))).collect()]
    assert got == [(None, True, 0, False), (INF, False, None, True), (11, False, 2, False), (None, False, None, False)]
