"""Analyses against brute force: data flow, automata, class order, formulas, edits, bands, packed sets, meets of zones."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from orrery.functions import formula as B
from orrery.functions import zones
from orrery.operators import alternating, bands, dataflow, edits, formulas, lattice, reach
from orrery.plans import fixpoint

ARC = "e long, src long, dst long"


def frame(spark, arcs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(arcs)], ARC)


def flow(arcs, made, stopped, boundary, n):
    """Facts on arrival, by rounds over all vertices."""
    found = {v: set(boundary.get(v, ())) for v in range(n)}
    while True:
        after = {v: set(s) for v, s in found.items()}
        for a, b in arcs:
            after[b] |= {(f, k) for f, k in found[a] if (a, k) not in stopped} | made.get(a, set())
        if after == found:
            return found
        found = after


@pytest.mark.parametrize("seed", [1, 2])
def test_facts_that_hold_on_some_and_on_all_ways(spark, seed):
    rng = random.Random(seed)
    n = 12
    arcs = [(rng.randrange(n), rng.randrange(n)) for _ in range(20)]
    made = [(rng.randrange(n), f, f % 2) for f in range(6) for _ in range(2)]
    stopped = [(rng.randrange(n), rng.randrange(2)) for _ in range(5)]
    a = frame(spark, [*arcs, arcs[0], (None, 3)])
    m = spark.createDataFrame(made, "v long, fact long, kind long")
    s = spark.createDataFrame([*stopped, stopped[0]], "v long, kind long")
    b = spark.createDataFrame([(0, 99, 1)], "v long, fact long, kind long")
    makes = {}
    for v, f, k in made:
        makes.setdefault(v, set()).add((f, k))
    for forward, ways in ((True, arcs), (False, [(y, x) for x, y in arcs])):
        want = flow(ways, makes, set(stopped), {0: {(99, 1)}}, n)
        got = {(r.v, r.fact, r.kind) for r in dataflow.holding(a, m, s, b, forward).collect()}
        assert got == {(v, f, k) for v, facts in want.items() for f, k in facts}
    # On all ways from 0: the greatest solution.
    every = {(f, k) for _, f, k in made}
    held = {v: set(every) for v in range(n)}
    held[0] = set()
    while True:
        after = {v: set(x) for v, x in held.items()}
        for x, y in arcs:
            after[y] &= {(f, k) for f, k in held[x] if (x, k) not in stopped} | makes.get(x, set())
        if after == held:
            break
        held = after
    got = {(r.v, r.fact, r.kind) for r in dataflow.holding_always(spark.range(n).toDF("v"), frame(spark, arcs), m, s, spark.range(1).toDF("v")).collect()}
    assert got == {(v, f, k) for v, facts in held.items() for f, k in facts}
    assert dataflow.holding(a.filter("false"), m, s).count() == 0


def test_settled_values_are_sent_on_only_when_they_change(spark):
    rng = random.Random(5)
    n = 30
    arcs = [(i, rng.randrange(n), rng.randrange(n), rng.randrange(50)) for i in range(70)]
    a = spark.createDataFrame([*arcs, (99, 3, None, 1)], ARC + ", cap long")
    start = spark.createDataFrame([(0, 40), (0, 45), (7, 9), (None, 1)], "v long, fact long")
    best = {0: 45, 7: 9}
    changed = True
    while changed:
        changed = False
        for _, x, y, cap in arcs:
            if x in best and min(best[x], cap) > best.get(y, -1):
                best[y], changed = min(best[x], cap), True
    got = {r.v: r.fact for r in dataflow.settled(a, start, lambda f: F.least(f, F.col("cap")), F.max).collect()}
    assert got == best
    assert dataflow.settled(a, start.filter("false"), lambda f: f, F.max).count() == 0


def accepted(clauses, letters, cycle, accepting, initial):
    """Greatest fixpoint of least fixpoints over (place, state)."""
    n, states = len(letters), {c[0] for c in clauses} | {s for c in clauses for s in c[3] if s is not None}
    ahead = {p: p + 1 if p + 1 < n else cycle for p in range(n)}
    all_ = {(p, q) for p in range(n) for q in states}

    def step(x):
        return {(p, q) for p, q in all_ if any(c[0] == q and c[1] == letters[p] and all(s is None or (ahead[p], s) in x for s in c[3]) for c in clauses)}

    x = set(all_)
    while True:
        y = set()
        while True:
            more = step(y) | {(p, q) for p, q in step(x) if q in accepting}
            if more == y:
                break
            y = more
        if y == x:
            return (0, initial) in x
        x = y


def test_lassos_through_an_alternating_automaton(spark):
    rng = random.Random(9)
    clauses = [(rng.randrange(4), rng.choice("ab"), i, [rng.randrange(4) for _ in range(rng.choice([1, 1, 2, 3]))]) for i in range(10)] + [(2, "a", 77, [None])]
    runs, want = [], {}
    for r in range(40):
        n = rng.randrange(1, 5)
        letters, cycle = [rng.choice("ab") for _ in range(n)], rng.randrange(n + 1)
        runs += [(r, p, letters[p], p >= cycle) for p in range(n)]
        want[r] = accepted(clauses, letters, cycle if cycle < n else -1, {1, 3}, 0)
    table = spark.createDataFrame([(q, a, i, s) for q, a, i, succ in clauses for s in succ], "state long, letter string, clause long, succ long")
    words = spark.createDataFrame(runs, "run_id long, pos long, letter string, in_cycle boolean")
    good = spark.createDataFrame([(1,), (3,), (3,)], "state long")
    got = {r.run_id: r.accepted for r in alternating.accepted_lassos(table, words, good, 0).collect()}
    assert got == want and len(set(want.values())) == 2
    # As a nondeterministic automaton on finite words.
    steps = {(q, a, s) for q, a, _, succ in clauses for s in succ if s is not None}
    ends = {}
    for r in want:
        at = {0}
        for _, _, letter, _ in sorted(x for x in runs if x[0] == r):
            at = {s for q, a, s in steps if q in at and a == letter}
        ends[r] = bool(at & {1, 3})
    moves = spark.createDataFrame(sorted(steps), "src long, letter string, dst long")
    assert {r.run_id: r.accepted for r in alternating.accepted_words(moves, words, good, 0).collect()} == ends


def heights(arcs, n):
    found = dict.fromkeys(range(n), 0)
    for _ in range(n):
        for a, b in arcs:
            found[a] = max(found[a], found[b] + 1)
    return found


@pytest.mark.parametrize("seed", range(2))
def test_class_order_of_acyclic_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    arcs = [tuple(sorted(rng.sample(range(n), 2))) for _ in range(60)] + [(i, i + 1) for i in range(10, 30)]
    classes = spark.range(n).select(F.col("id").alias("v"), F.col("id").alias("class"))
    got = {r["class"]: r for r in reach.class_order(classes, frame(spark, [*arcs, (5, 5)])).collect()}
    assert {c: r.height for c, r in got.items()} == heights(arcs, n)
    assert sorted(r.number for r in got.values()) == list(range(n)) and all(got[a].number > got[b].number for a, b in arcs)


def test_class_order_of_a_long_chain_takes_few_tables(spark, monkeypatch):
    tables = []
    saved = fixpoint.saved
    monkeypatch.setattr(reach, "saved", lambda df: tables.append(1) or saved(df))
    n = 10_000
    chain = spark.range(n - 1).select(F.col("id").alias("e"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    classes = spark.range(n).select(F.col("id").alias("v"), F.col("id").alias("class"))
    got = reach.class_order(classes, chain)
    assert got.filter("height <> 9999 - class or number <> height").count() == 0 and got.count() == n
    assert len(tables) < 100
    assert reach.class_order(classes.filter("false"), chain).count() == 0


def drawn(rng, depth):
    kind = rng.choice(["name", "not", "and", "or"]) if depth else "name"
    if kind == "name":
        return B.embed(rng.random() < 0.5) if rng.random() < 0.1 else B.name(rng.choice("abcd"))
    if kind == "not":
        return ~drawn(rng, depth - 1)
    return B.Formula(kind, tuple(drawn(rng, depth - 1) for _ in range(rng.choice([1, 2, 2, 3]))))


def test_clauses_of_many_formulas(spark):
    rng = random.Random(3)
    made = {f"f{i}": drawn(rng, rng.randrange(4)) for i in range(60)}
    nodes = spark.createDataFrame(formulas.rows_of(made), "formula string, node long, parent long, kind string, label string").repartition(5)
    for outer in ("and", "or"):
        got = {}
        for r in formulas.clauses(nodes, outer).collect():
            got.setdefault(r.formula, set()).add(frozenset(r.clause))
        for word, f in made.items():
            every = {frozenset(B.text(x) for x in c) for c in B.clauses(f, outer)}
            assert got[word] == {c for c in every if not any(d < c for d in every)}
    # The clauses mean what the formula means.
    names = "abcd"
    table = spark.createDataFrame(list(product([False, True], repeat=4)), ", ".join(f"{x} boolean" for x in names))
    whole = {r.formula: r.clauses for r in formulas.clauses(nodes, "or").groupBy("formula").agg(F.collect_list("clause").alias("clauses")).collect()}
    for row in table.collect():
        value = lambda lit, row=row: {"T": True, "!T": False, "F": False, "!F": True}.get(lit, row[lit[-1]] != lit.startswith("!") if lit[-1] in names else None)
        worth = lambda f, row=row: f.args[0] if f.kind == "value" else row[f.args[0]] if f.kind == "name" else not worth(f.args[0]) if f.kind == "not" else (all if f.kind == "and" else any)(worth(x) for x in f.args)
        for word, f in made.items():
            assert any(all(value(x) for x in c) for c in whole[word]) == worth(f)
    assert formulas.clauses(nodes.filter("false")).count() == 0


def test_algebra_of_formulas(spark):
    rng = random.Random(8)
    kind = "formula string, node long, parent long, kind string, label string"
    f, g = ({f"f{i}": drawn(rng, 2) for i in range(25)} for _ in range(2))
    a, b = (spark.createDataFrame(formulas.rows_of(x), kind) for x in (f, g))
    value = {x: rng.random() < 0.5 for x in "abcd"}
    values = spark.createDataFrame([(w, x, v) for w in f for x, v in value.items()], "formula string, label string, value boolean")
    worth = lambda t: t.args[0] if t.kind == "value" else value[t.args[0]] if t.kind == "name" else not worth(t.args[0]) if t.kind == "not" else (all if t.kind == "and" else any)(worth(x) for x in t.args)
    made = {"and": formulas.combined(a, b, "and"), "or": formulas.combined(a, b, "or"), "not": formulas.negated(a)}
    want = {"and": {w: f[w] & g[w] for w in f}, "or": {w: f[w] | g[w] for w in f}, "not": {w: ~f[w] for w in f}}
    for op, nodes in made.items():
        got = {r.formula: r.value for r in formulas.truth(formulas.clauses(nodes, "or"), values).collect()}
        assert got == {w: worth(t) for w, t in want[op].items()}
        parts = {r.formula: r.n for r in formulas.parts_of(nodes, op).groupBy("formula").agg(F.count("*").alias("n")).collect()}
        assert parts == {w: len(t.args) for w, t in want[op].items()}


def one_by_one(arcs, sequence, vertices):
    arcs = list(arcs)
    for kind, e, src, dst in sequence:
        if kind == "remove":
            if e is not None and 0 <= e < len(arcs):
                del arcs[e]
        elif 0 <= src < vertices and 0 <= dst < vertices:
            arcs.insert(sum(a <= src for a, _ in arcs), (src, dst))
    return arcs


@pytest.mark.parametrize("chunk", [7, 1000])
def test_a_thousand_edits_equal_a_thousand_single_ones(spark, chunk):
    rng = random.Random(chunk)
    n = 20
    arcs = sorted((rng.randrange(n), rng.randrange(n)) for _ in range(300))
    count = 1000 if chunk == 1000 else 60
    sequence = [("insert", None, rng.randrange(-1, n + 2), rng.randrange(n)) if rng.random() < 0.5 else ("remove", rng.randrange(-2, 330), None, None) for _ in range(count)] + [("remove", None, None, None)]
    table = spark.createDataFrame([(t, *x) for t, x in enumerate(sequence)], "t long, kind string, e long, src long, dst long").repartition(3)
    got = edits.edited(frame(spark, arcs), table, n, chunk).orderBy("e").collect()
    want = one_by_one(arcs, sequence, n)
    assert [(r.e, r.src, r.dst) for r in got] == [(i, *a) for i, a in enumerate(want)]
    assert edits.edited(frame(spark, arcs).filter("false"), table.filter("kind = 'remove'"), n).count() == 0


def test_bands_hold_their_positions(spark):
    rows = [(i, s) for i, s in enumerate([3, 0, None, 5, 10_000, 1, 0])]
    found = bands.in_order(spark.createDataFrame(rows, "k long, size long").repartition(4), ["k"], "size")
    at, want = 0, {}
    for k, s in rows:
        want[k] = (at, at + (s or 0))
        at += s or 0
    assert {r.k: (r.first, r.stop) for r in found.collect()} == want
    places = spark.createDataFrame([(p,) for p in (-1, 0, 2, 3, 7, 8, 5000, 10_007, 10_008, 10_009, None)], "at long")
    got = {r.at: r.k for r in bands.lookup(places, found, "at").collect()}
    assert got == {p: k for p in (0, 2, 3, 7, 8, 5000, 10_007, 10_008) for k, (a, b) in want.items() if a <= p < b}


@pytest.mark.parametrize("n", [1, 64, 130])
def test_packed_sets_are_sets(spark, n):
    rng = random.Random(n)
    sets = {k: ({rng.randrange(n) for _ in range(rng.randrange(n + 1))}, {rng.randrange(n) for _ in range(rng.randrange(4))}) for k in range(12)}
    sets[12] = (set(range(n)), set())
    rows = [(k, side, bit) for k, both in sets.items() for side in (0, 1) for bit in (*both[side], None, -1, n)]
    table = spark.createDataFrame(rows, "k long, side long, bit long")
    both = lattice.packed(table.filter("side = 0"), "k", "bit", n, "a").join(lattice.packed(table.filter("side = 1"), "k", "bit", n, "b"), "k")
    a, b, at = F.col("a"), F.col("b"), F.lit(n - 1)
    got = both.select("k", *[lattice.places_of(x).alias(c) for c, x in (("join", lattice.join_words(a, b)), ("meet", lattice.meet_words(a, b)), ("minus", lattice.minus_words(a, b)), ("not", lattice.complement_words(a, n)), ("set", lattice.set_word_bit(b, F.lit(n + 70), F.lit(True))), ("unset", lattice.set_word_bit(a, at, F.lit(False))))], lattice.count_words(a).alias("n"), lattice.compare_words(a, b).alias("compared"), lattice.word_bit(a, at).alias("last"), lattice.word_bit(a, F.lit(5000)).alias("far"), lattice.no_words(b).alias("none"))
    rows = got.collect()
    assert len(rows) == 13
    for r in rows:
        x, y = sets[r.k]
        want = [x | y, x & y, x - y, set(range(n)) - x, y | {n + 70}, x - {n - 1}]
        assert [r["join"], r["meet"], r["minus"], r["not"], r["set"], r["unset"]] == [sorted(w) for w in want]
        assert (r.n, r.compared, r["last"], r.far, r.none) == (len(x), 0 if x == y else -1 if x < y else 1 if x > y else None, n - 1 in x, False, not y)
    grouped = both.withColumn("g", F.col("k") % 2)
    for f, op in ((lattice.join_packed, set.union), (lattice.meet_packed, set.intersection)):
        for r in f(grouped, "g", "a", lattice.words_for(n)).select("g", lattice.places_of(F.col("a")).alias("bits")).collect():
            assert r.bits == sorted(op(*[sets[k][0] for k in sets if k % 2 == r.g]))


def test_meet_of_many_zones(spark):
    rng = random.Random(2)
    rows = [(i % 4, [rng.randrange(-9, 40) for _ in range(9)]) for i in range(30)] + [(7, None), (0, None)]
    got = {r.k: r.zone for r in zones.meet_of(spark.createDataFrame(rows, "k long, zone array<int>"), "k", 3).collect()}
    want = {k: [min(z[i] for g, z in rows if g == k and z) for i in range(9)] for k in range(4)} | {7: None}
    assert got == want
