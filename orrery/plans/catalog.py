"""Queries over the test tables, one for each operator or small family, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import formula as B
from orrery.functions import shell, zones
from orrery.operators import acceptance as A
from orrery.operators import games, graph, lattice, views
from orrery.operators import reach as R
from orrery.plans.fixpoint import clearings, saved
from orrery.sources import graphs as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_ARCS = "arcs AS (SELECT o_orderkey AS o, o_custkey AS src, o_orderkey * 7 % (SELECT count(*) FROM customer) AS dst, substr(o_orderpriority, 1, 1) AS letter FROM orders)"
_GRAPH = f"{_ARCS}, u AS (SELECT o, src, dst FROM arcs), v AS (SELECT c_custkey AS v, CASE WHEN c_custkey % 2 = 0 THEN 'Eve' ELSE 'Adam' END AS owner, c_acctbal AS balance FROM customer)"
_RUNS = "runs AS (SELECT run_id, pos, state, pos >= count(*) OVER (PARTITION BY run_id) - 1 - run_id % 3 AS in_cycle FROM (SELECT user_id * 1000000 + p // (3 + user_id % 6) AS run_id, p % (3 + user_id % 6) AS pos, event_type AS state FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events)))"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LAYERS = "u AS (SELECT o_orderkey AS o, o_custkey AS src, CASE o_orderkey % 4 WHEN 0 THEN o_custkey - o_custkey % greatest(n // 8, 1) WHEN 1 THEN least(o_custkey + 1 + o_orderkey // 4 % 2, n - 1) ELSE least(o_custkey + 1 + o_orderkey * 7919 % greatest(n // 10, 1), n - 1) END AS dst FROM orders, (SELECT count(*) AS n FROM customer)), v AS (SELECT c_custkey AS v, CASE WHEN c_custkey % 2 = 0 THEN 'Eve' ELSE 'Adam' END AS owner, c_acctbal AS balance FROM customer)"


def _layers(spark, d: str) -> DataFrame:
    return saved(S.layered_arcs(spark, d))


_kept: dict = {}


def _classes(spark, d: str) -> DataFrame:
    """Components of the layered graph, a table that the queries of one application share while its files stay as they are."""
    files = [spark.read.parquet(f"{d}/{t}.parquet").agg(F.max("_metadata.file_modification_time"), F.sum("_metadata.file_size"), F.count("*")).first() for t in ("orders", "customer")]
    key = spark.sparkContext.applicationId, clearings(spark), d, *map(tuple, files)
    if key not in _kept:
        _kept[key] = saved(R.components(S.customer_arena(spark, d), _layers(spark, d)))
    return _kept[key]


def _arcs(spark, d: str) -> DataFrame:
    """All arcs of the order graph, numbered by their order's key."""
    return saved(S.order_arcs(spark, d).select(F.col("o").alias("e"), "src", "dst"))


def _supply(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


@_query(f"""WITH RECURSIVE {_GRAPH}, st(depth, seen, front) AS (SELECT 0::BIGINT, [1::BIGINT], [1::BIGINT] UNION ALL
  SELECT depth + 1, seen || fresh, fresh FROM (SELECT depth, seen, (SELECT list(DISTINCT dst) FROM u WHERE list_contains(st.front, src) AND NOT list_contains(st.seen, dst)) AS fresh FROM st) WHERE len(fresh) > 0)
SELECT unnest(front) AS v, depth FROM st""")
def reach_depth(spark, d):
    return R.reach(_arcs(spark, d), spark.range(1, 2).toDF("v"))


@_query("WITH n AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS e FROM (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)) SELECT e, src, dst FROM n")
def numbered_multigraph(spark, d):
    return S.numbered_arcs(_supply(spark, d))


@_query("WITH a AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem), t AS (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) FROM a) + 1)) AS v), o AS (SELECT src AS v, count(*) AS n, count(*) FILTER (src = dst) AS loops FROM a GROUP BY src), i AS (SELECT dst AS v, count(*) AS n FROM a GROUP BY dst) SELECT v, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming, coalesce(loops, 0) AS loops FROM t LEFT JOIN o USING (v) LEFT JOIN i USING (v)")
def degree_table(spark, d):
    arcs = _supply(spark, d)
    return graph.degrees(S.vertex_range(arcs), arcs)


@_query(f"WITH {_ARCS} SELECT v, count(*) AS degree FROM (SELECT src AS v FROM arcs UNION ALL SELECT dst FROM arcs) GROUP BY v")
def undirected_degree(spark, d):
    return graph.undirected_degrees(S.order_arcs(spark, d))


@_query("SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY ALL")
def parallel_arcs(spark, d):
    return graph.connections(_supply(spark, d))


@_query(f"WITH {_ARCS} SELECT src AS v, dst AS neighbour FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY o) AS k FROM arcs) WHERE k = 3")
def third_successor(spark, d):
    return graph.neighbour_at(S.order_arcs(spark, d).withColumnRenamed("o", "e"), 2)


@_query(f"WITH {_ARCS} SELECT dst AS v, src AS neighbour FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY o) AS k FROM arcs) WHERE k = 1")
def first_predecessor(spark, d):
    return graph.neighbour_at(S.order_arcs(spark, d).withColumnRenamed("o", "e"), 0, forward=False)


@_query("WITH n AS (SELECT l_partkey AS src, row_number() OVER (ORDER BY l_partkey, l_suppkey) - 1 AS e FROM lineitem) SELECT src, min(e) AS first, max(e) + 1 AS stop FROM n GROUP BY src")
def neighbour_range(spark, d):
    return graph.neighbour_ranges(S.numbered_arcs(_supply(spark, d)))


@_query(f"WITH {_ARCS} SELECT row_number() OVER (ORDER BY o) - 1 AS e, src - (src > 5)::INT AS src, dst - (dst > 5)::INT AS dst FROM arcs WHERE src <> 5 AND dst <> 5")
def remove_vertex(spark, d):
    return graph.remove_vertex(S.order_arcs(spark, d).withColumnRenamed("o", "e"), 5)


@_query("WITH n AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS e FROM (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)) SELECT e - (e > 7)::INT AS e, src, dst FROM n WHERE e <> 7")
def remove_arc(spark, d):
    return graph.remove_arc(S.numbered_arcs(_supply(spark, d)), 7)


@_query("WITH n AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS e FROM (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)), a AS (SELECT max(e) + 1 AS a FROM n WHERE src <= 3) SELECT e + (e >= a)::INT AS e, src, dst FROM n, a UNION ALL SELECT a, 3, 4 FROM a")
def insert_arc(spark, d):
    arcs = saved(S.numbered_arcs(_supply(spark, d)))
    return graph.insert_arc(arcs, S.vertex_range(arcs), 3, 4)


@_query(f"WITH {_ARCS}, p AS (SELECT DISTINCT src, dst FROM arcs) SELECT src, dst, CASE WHEN dst >= src THEN dst * dst + src ELSE src * src + 2 * src - dst END AS e, src AS back_src, dst AS back_dst FROM p")
def shell_index_roundtrip(spark, d):
    pairs = S.simple_arcs(S.order_arcs(spark, d)).withColumn("e", shell.shell_index(F.col("src"), F.col("dst")))
    return pairs.withColumn("pair", shell.shell_pair(F.col("e"))).select("src", "dst", "e", F.col("pair.src").alias("back_src"), F.col("pair.dst").alias("back_dst"))


def _hyper(spark, d):
    return S.hyperarcs(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_partkey", "l_suppkey")


@_query("WITH x AS (SELECT l_partkey AS v, 1 AS o, 0 AS i FROM lineitem UNION ALL SELECT l_suppkey, 0, 1 FROM lineitem) SELECT v, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM x GROUP BY v")
def hyper_degrees(spark, d):
    return graph.hyper_degrees(_hyper(spark, d))


@_query("SELECT DISTINCT b.l_suppkey AS v FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def hyper_forward(spark, d):
    frontier = spark.read.parquet(f"{d}/part.parquet").filter("p_size = 1").select(F.col("p_partkey").alias("v"))
    return graph.hyper_step(frontier, _hyper(spark, d))


@_query("SELECT DISTINCT b.l_partkey AS v FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def hyper_backward(spark, d):
    frontier = spark.read.parquet(f"{d}/supplier.parquet").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("v"))
    return graph.hyper_step(frontier, _hyper(spark, d), forward=False)


@_query(f"WITH {_ARCS}, s AS (SELECT c_custkey AS v, c_acctbal >= 0 AS side FROM customer) SELECT o AS e, src, dst FROM arcs LEFT JOIN s a ON a.v = src LEFT JOIN s b ON b.v = dst WHERE NOT coalesce(a.side <> b.side, false)")
def bipartite_violations(spark, d):
    sides = S.customer_arena(spark, d).select("v", (F.col("balance") >= 0).alias("side"))
    return graph.crossing_violations(S.order_arcs(spark, d).withColumnRenamed("o", "e"), sides)


@_query(f"WITH {_GRAPH}, a AS (SELECT * FROM u WHERE src % 10 <> 3 AND dst % 10 <> 3) SELECT v, v NOT IN (SELECT src FROM a UNION SELECT dst FROM a) AS feasible FROM v")
def side_change_feasible(spark, d):
    """In the graph without the arcs of every tenth customer, who stays as a vertex."""
    arcs = _arcs(spark, d).filter("src % 10 <> 3 and dst % 10 <> 3")
    return graph.can_change_side(arcs, S.customer_arena(spark, d))


@_query(f"WITH {_GRAPH} SELECT dst AS v, count(*) AS n FROM u JOIN v ON v.v = src WHERE balance < 0 GROUP BY dst")
def forward_expansion(spark, d):
    frontier = S.customer_arena(spark, d).filter("balance < 0")
    return graph.step(frontier, _arcs(spark, d)).groupBy("v").agg(F.count("*").alias("n"))


@_query(f"WITH {_GRAPH} SELECT src AS v, count(*) AS n FROM u JOIN v ON v.v = dst WHERE balance < 0 GROUP BY src")
def backward_expansion(spark, d):
    frontier = S.customer_arena(spark, d).filter("balance < 0")
    return graph.step(frontier, _arcs(spark, d), forward=False).groupBy("v").agg(F.count("*").alias("n"))


@_query(f"WITH {_ARCS} SELECT src, letter, dst, count(*) AS n FROM arcs GROUP BY ALL")
def transitions_by_letter(spark, d):
    return S.order_arcs(spark, d).groupBy("src", "letter", "dst").agg(F.count("*").alias("n"))


_SCC = f"WITH RECURSIVE {_LAYERS}, p AS (SELECT DISTINCT src, dst FROM u), t AS (SELECT src AS a, dst AS b FROM p UNION SELECT t.a, p.dst FROM t JOIN p ON p.src = t.b), m AS (SELECT x.a, x.b FROM t x JOIN t y ON y.a = x.b AND y.b = x.a), c AS (SELECT v.v, least(v.v, coalesce(min(m.b), v.v)) AS class FROM v LEFT JOIN m ON m.a = v.v GROUP BY v.v)"


@_query(f"{_SCC} SELECT v, class FROM c")
def scc_classes(spark, d):
    return _classes(spark, d)


@_query(f"{_SCC} SELECT class, count(*) AS size, count(*) > 1 OR bool_or(v IN (SELECT src FROM p WHERE src = dst)) AS recurrent FROM c GROUP BY class")
def recurrent_classes(spark, d):
    arcs = _layers(spark, d)
    return R.recurrent(_classes(spark, d), arcs)


@_query(f"{_SCC}, k AS (SELECT class FROM c GROUP BY class HAVING count(*) > 1 OR bool_or(v IN (SELECT src FROM p WHERE src = dst))) SELECT DISTINCT a.class AS src_class, b.class AS dst_class FROM p JOIN c a ON a.v = src JOIN c b ON b.v = dst WHERE a.class <> b.class UNION SELECT class, class FROM k")
def condensation_arcs(spark, d):
    arcs = _layers(spark, d)
    return R.condensation(_classes(spark, d), arcs)


_REACHED = ", s AS (SELECT 1::BIGINT AS v UNION SELECT p.dst FROM s JOIN p ON p.src = s.v)"


@_query(f"{_SCC}{_REACHED}, k AS (SELECT class FROM c GROUP BY class HAVING count(*) > 1 OR bool_or(v IN (SELECT src FROM p WHERE src = dst))) SELECT DISTINCT class FROM c JOIN s USING (v) JOIN v USING (v) JOIN k USING (class) WHERE balance < 0")
def buchi_emptiness(spark, d):
    arena = S.customer_arena(spark, d)
    return R.buchi_nonempty(_layers(spark, d), spark.range(1, 2).toDF("v"), arena.filter("balance < 0"))


def _parity_sql() -> str:
    parts = []
    for k in (0, 2, 4):
        parts.append(f"""SELECT DISTINCT {k}::BIGINT AS priority, class FROM (
          WITH RECURSIVE q AS (SELECT DISTINCT src, dst FROM p JOIN w a ON a.v = src JOIN w b ON b.v = dst WHERE a.priority >= {k} AND b.priority >= {k}),
          t AS (SELECT src AS a, dst AS b FROM q UNION SELECT t.a, q.dst FROM t JOIN q ON q.src = t.b)
          SELECT x.a AS v, min(x.b) AS class FROM t x JOIN t y ON y.a = x.b AND y.b = x.a GROUP BY x.a) JOIN w USING (v) WHERE priority = {k}""")
    return f"WITH RECURSIVE {_LAYERS}, p AS (SELECT DISTINCT src, dst FROM u){_REACHED}, w AS (SELECT n.v, (n.c_nationkey % 5)::INT AS priority FROM (SELECT c_custkey AS v, c_nationkey FROM customer) n JOIN s USING (v)) " + " UNION ALL ".join(parts)


@_query(_parity_sql())
def parity_emptiness(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("v"), (F.col("c_nationkey") % 5).alias("priority"))
    return R.parity_nonempty(_layers(spark, d), spark.range(1, 2).toDF("v"), c)


def _attractor_sql(target: str, player: str) -> str:
    return f"""WITH RECURSIVE {_GRAPH}, st(i, r, n) AS (
      SELECT 0, list(v), count(*) FROM v WHERE {target}
      UNION ALL
      SELECT i + 1, nr, len(nr) FROM (SELECT i, n, (SELECT list(DISTINCT x) FROM (SELECT unnest(st.r) AS x UNION ALL
        SELECT src FROM u JOIN v ON v.v = u.src GROUP BY src, owner
        HAVING CASE WHEN owner = '{player}' THEN bool_or(list_contains(st.r, dst)) ELSE bool_and(list_contains(st.r, dst)) END)) AS nr FROM st) WHERE len(nr) > n),
    reg AS (SELECT unnest(r) AS v FROM (SELECT r FROM st ORDER BY i DESC LIMIT 1))"""


_TARGET = "balance > 8000"
_UNSAFE = "(balance < -600 OR v NOT IN (SELECT src FROM u))"


@_query(f"{_attractor_sql(_TARGET, 'Eve')} SELECT v FROM reg")
def attractor_region(spark, d):
    arena = S.customer_arena(spark, d)
    return games.attractor(arena, _arcs(spark, d), arena.filter(_TARGET), "Eve").select("v")


@_query(f"{_attractor_sql(_TARGET, 'Eve')} SELECT v, true AS wins FROM reg")
def reach_strategy_wins(spark, d):
    """Where the synthesised strategy wins against every opponent: the whole region, if it is right."""
    arena, arcs = S.customer_arena(spark, d), _arcs(spark, d)
    region = saved(games.attractor(arena, arcs, arena.filter(_TARGET), "Eve"))
    strategy = saved(games.attractor_strategy(arena, arcs, region, "Eve"))
    return games.verify_reach_strategy(arena, arcs, strategy, arena.filter(_TARGET), "Eve").withColumn("wins", F.lit(True))


@_query(f"{_attractor_sql(_UNSAFE, 'Adam')} SELECT v FROM v WHERE v NOT IN (SELECT v FROM reg)")
def safety_region(spark, d):
    arena = S.customer_arena(spark, d)
    return games.safety_region(arena, _arcs(spark, d), arena.filter("not balance < -600"), "Eve")


@_query(f"{_attractor_sql(_UNSAFE, 'Adam')}, w AS (SELECT v FROM v WHERE v NOT IN (SELECT v FROM reg)) SELECT src AS v, arg_min(dst, o) AS succ FROM u JOIN v ON v.v = src WHERE owner = 'Eve' AND src IN (SELECT v FROM w) AND dst IN (SELECT v FROM w) GROUP BY src")
def safety_strategy(spark, d):
    arena, arcs = S.customer_arena(spark, d), _arcs(spark, d)
    region = saved(games.safety_region(arena, arcs, arena.filter("not balance < -600"), "Eve"))
    return games.safety_strategy(arena, arcs, region, "Eve")


_BUCHI = f"""WITH RECURSIVE {_GRAPH}, st(i, phase, c, r) AS (
  SELECT 0, 0, (SELECT list(v) FROM v), (SELECT list(v) FROM v WHERE balance > 5000 AND v IN (SELECT src FROM u))
  UNION ALL
  SELECT i + 1,
    CASE WHEN grew THEN phase WHEN phase = 0 THEN 1 ELSE 0 END,
    CASE WHEN NOT grew AND phase = 1 THEN c2 ELSE c END,
    CASE WHEN grew THEN nr WHEN phase = 0 THEN c2 ELSE (SELECT coalesce(list(src), []) FROM (SELECT src FROM u JOIN v ON v.v = u.src WHERE balance > 5000 AND list_contains(g.c2, src) GROUP BY src, owner
      HAVING CASE WHEN owner = 'Eve' THEN bool_or(list_contains(g.c2, dst)) ELSE bool_and(list_contains(g.c2, dst)) END)) END
  FROM (SELECT *, len(nr) > len(r) AS grew, list_filter(c, lambda x: NOT list_contains(r, x)) AS c2 FROM (
    SELECT i, phase, c, r, (SELECT list(DISTINCT x) FROM (SELECT unnest(st.r) AS x UNION ALL SELECT src FROM u JOIN v ON v.v = u.src WHERE list_contains(st.c, src) GROUP BY src, owner
      HAVING CASE WHEN (owner = 'Eve') = (st.phase = 0) THEN bool_or(list_contains(st.r, dst)) ELSE bool_and(list_contains(st.r, dst)) END)) AS nr FROM st)) g
  WHERE grew OR phase = 1 OR len(c2) > 0)
SELECT unnest(c) AS v FROM (SELECT c FROM st ORDER BY i DESC LIMIT 1)"""


@_query(_BUCHI)
def buchi_region(spark, d):
    arena = S.customer_arena(spark, d)
    return games.buchi_region(arena, _arcs(spark, d), arena.filter("balance > 5000"), "Eve")




def _accept(name: str, run, having: str):
    def query(spark, d):
        return run(S.user_runs(spark, d))

    query.__name__ = f"accept_{name}"
    _query(f"WITH {_RUNS} SELECT run_id, coalesce({having}, false) AS accepted FROM runs GROUP BY run_id")(query)


def _inf(state: str) -> str:
    return f"coalesce(bool_or(state = '{state}') FILTER (in_cycle), false)"


def _register_acceptance(a: str, b: str, c: str) -> None:
    """a, b, c: three event types. Priorities leave the others without one, or give all of them one."""
    ranks = {a: 0, b: 1, c: 2}
    rank = f"CASE state WHEN '{a}' THEN 0 WHEN '{b}' THEN 1 WHEN '{c}' THEN 2 END"
    full = f"(count(state) FILTER (in_cycle) > 0 AND count({rank}) FILTER (in_cycle) = count(state) FILTER (in_cycle))"
    _accept("final", lambda r: A.final(r, [a, b]), f"arg_max(state, pos) IN ('{a}', '{b}')")
    _accept("buchi", lambda r: A.buchi(r, [a]), _inf(a))
    _accept("co_buchi", lambda r: A.co_buchi(r, [a]), f"NOT {_inf(a)}")
    _accept("muller", lambda r: A.muller(r, [[a, b, c], [a], [b, c], [a, b], [c]]), f"list_sort(list(DISTINCT state) FILTER (in_cycle)) IN (list_sort(['{a}', '{b}', '{c}']), ['{a}'], list_sort(['{b}', '{c}']), list_sort(['{a}', '{b}']), ['{c}'])")
    _accept("rabin", lambda r: A.rabin(r, [([a], [b]), ([c], [a])]), f"(NOT {_inf(a)} AND {_inf(b)}) OR (NOT {_inf(c)} AND {_inf(a)})")
    _accept("streett", lambda r: A.streett(r, [([a], [b]), ([c], [a])]), f"(NOT {_inf(a)} OR {_inf(b)}) AND (NOT {_inf(c)} OR {_inf(a)})")
    for least, even in ((True, True), (True, False), (False, True), (False, False)):
        word = f"parity_{'min' if least else 'max'}_{'even' if even else 'odd'}"
        _accept(word, lambda r, least=least, even=even: A.parity(r, ranks, least, even), f"{full} AND {'min' if least else 'max'}({rank}) FILTER (in_cycle) % 2 = {0 if even else 1}")


_register_acceptance("click", "purchase", "view")


@_query(f"WITH {_RUNS} SELECT DISTINCT run_id, state FROM runs WHERE in_cycle")
def infinitely_often(spark, d):
    return A.infinitely_often(S.user_runs(spark, d))


@_query(f"WITH {_RUNS} SELECT DISTINCT run_id, state FROM runs WHERE NOT in_cycle EXCEPT SELECT run_id, state FROM runs WHERE in_cycle")
def finitely_often(spark, d):
    return A.finitely_often(S.user_runs(spark, d))


@_query(f"WITH {_RUNS} SELECT run_id, state, min(pos) AS pos FROM runs GROUP BY ALL")
def first_seen_states(spark, d):
    return A.first_seen(S.user_runs(spark, d))


@_query(f"WITH {_RUNS}, n AS (SELECT run_id, count(*) AS n, count(*) FILTER (in_cycle) AS c FROM runs GROUP BY run_id), s AS (SELECT run_id, n, c, unnest(range(20)) AS step FROM n) SELECT s.run_id, step, state FROM s JOIN runs ON runs.run_id = s.run_id AND pos = CASE WHEN step < n THEN step WHEN c > 0 THEN n - c + (step - n) % c END")
def lasso_unroll(spark, d):
    return A.unroll(S.user_runs(spark, d), 20)


@_query(f"WITH {_RUNS} SELECT run_id, bool_or(state = 'purchase') AS reaches, bool_and(state = 'purchase') AS stays, bool_or(state = 'purchase' AND in_cycle) AS recurs FROM runs GROUP BY run_id")
def play_objectives(spark, d):
    return games.objective(S.user_runs(spark, d), spark.createDataFrame([("purchase",)], "state string"))


@_query(f"WITH {_RUNS} SELECT run_id, true AS reaches, bool_and(state <> 'purchase') AS stays, bool_or(state <> 'purchase' AND in_cycle) AS recurs FROM runs GROUP BY run_id HAVING bool_or(state <> 'purchase')")
def play_safety(spark, d):
    runs = S.user_runs(spark, d)
    return games.objective(runs, runs.select("state").distinct().filter("state <> 'purchase'")).filter("reaches")


@_query(f"WITH {_RUNS}, c AS (SELECT run_id, state, coalesce(lead(state) OVER w, first_value(state) OVER w) AS next FROM runs WHERE in_cycle WINDOW w AS (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT DISTINCT run_id, state AS src, next AS dst FROM c")
def infinitely_often_transitions(spark, d):
    return A.infinitely_often_transitions(S.user_runs(spark, d))


@_query(f"WITH {_RUNS}, c AS (SELECT run_id, state, coalesce(lead(state) OVER w, first_value(state) OVER w) AS next FROM runs WHERE in_cycle WINDOW w AS (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), h AS (SELECT run_id, bool_or((state = 'click' AND next = 'view') OR (state = 'view' AND next = 'view') OR state = 'login') AS hit FROM c GROUP BY run_id) SELECT DISTINCT runs.run_id, coalesce(hit, false) AS accepted FROM runs LEFT JOIN h ON h.run_id = runs.run_id")
def accept_buchi_transitions(spark, d):
    runs = S.user_runs(spark, d)
    after_login = runs.select(F.lit("login").alias("src"), F.col("state").alias("dst")).distinct()
    return A.buchi_transitions(runs, spark.createDataFrame([("click", "view"), ("view", "view")], "src string, dst string").unionByName(after_login))


_SETS = "s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey % 4)) AS a, list_sort(list(DISTINCT l_partkey % 3)) AS b FROM lineitem GROUP BY l_orderkey)"


def _sets(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 4)).alias("a"), F.array_sort(F.collect_set(F.col("l_partkey") % 3)).alias("b"))


def _listed(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _text(c: str) -> str:
    return f"array_to_string({c}, ',')"


@_query(f"WITH {_SETS}, x AS (SELECT k, a, b, list_intersect(a, b) AS m FROM s) SELECT k, {_text('list_sort(list_distinct(a || b))')} AS joined, {_text('list_sort(m)')} AS met, {_text('list_filter(a, lambda y: NOT list_contains(b, y))')} AS minus, len(m) = len(a) AS below, len(m) = 0 AS apart, CASE WHEN len(m) = len(a) AND len(m) = len(b) THEN 0 WHEN len(m) = len(a) THEN -1 WHEN len(m) = len(b) THEN 1 END AS compared FROM x")
def set_lattice(spark, d):
    a, b = F.col("a"), F.col("b")
    return _sets(spark, d).select("k", _listed(lattice.join_sets(a, b)).alias("joined"), _listed(lattice.meet_sets(a, b)).alias("met"), _listed(lattice.difference(a, b)).alias("minus"), lattice.is_subset(a, b).alias("below"), lattice.is_disjoint(a, b).alias("apart"), lattice.compare_sets(a, b).alias("compared"))


@_query(f"WITH {_SETS} SELECT k, {_text('list_sort(list_distinct(a || [2]))')} AS more, {_text('list_filter(a, lambda y: y <> 2)')} AS less, list_contains(a, 2) AS held, len(a)::INT AS n, len(list_intersect(a, b)) = 0 AS met_bottom, len(b) = 3 AS b_top FROM s")
def set_membership(spark, d):
    a, b, two = F.col("a"), F.col("b"), F.lit(2).cast("long")
    return _sets(spark, d).select("k", _listed(lattice.with_element(a, two)).alias("more"), _listed(lattice.without_element(a, two)).alias("less"), F.array_contains(a, 2).alias("held"), F.size(a).alias("n"), (lattice.meet_sets(a, b) == lattice.bottom_of()).alias("met_bottom"), (b == lattice.top_of(F.lit(3))).alias("b_top"))


@_query(f"WITH {_SETS} SELECT k, {_text('list_filter(range(4), lambda y: NOT list_contains(a, y))')} AS complement, {_text('list_sort(list_distinct(a || b))')} AS joined, list_contains(a, 3) AS third, {_text('list_filter(a, lambda y: y <> 3)')} AS cleared FROM s")
def bit_array_lattice(spark, d):
    a, b, n, three = F.col("a"), F.col("b"), F.lit(4), F.lit(3).cast("long")
    return _sets(spark, d).select("k", _listed(lattice.complement(a, n)).alias("complement"), _listed(lattice.join_sets(a, b)).alias("joined"), lattice.bit_at(a, n, three).alias("third"), _listed(lattice.set_bit(a, n, three, F.lit(False))).alias("cleared"))


@_query(f"WITH {_SETS}, g AS (SELECT k, a, b, list_max(a) + 1 AS la, list_max(b) + 1 AS lb, list_intersect(a, b) AS m FROM s) SELECT k, {_text('list_sort(list_distinct(a || b))')} AS joined, {_text('list_sort(m)')} AS met, greatest(la, lb) AS len, greatest(la, 3) AS grown, CASE WHEN la <> lb THEN NULL WHEN len(m) = len(a) AND len(m) = len(b) THEN 0 WHEN len(m) = len(a) THEN -1 WHEN len(m) = len(b) THEN 1 END AS compared FROM g")
def bit_vector_lattice(spark, d):
    """Vectors that end with their last one."""
    grown = lambda c: F.struct(F.col(c).alias("bits"), (F.array_max(c) + 1).alias("len"))
    s = _sets(spark, d).select("k", grown("a").alias("a"), grown("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    joined, met, more = lattice.join_growable(a, b), lattice.meet_growable(a, b), lattice.set_growable(a, F.lit(2).cast("long"), F.lit(True))
    return s.select("k", _listed(joined["bits"]).alias("joined"), _listed(met["bits"]).alias("met"), met["len"].alias("len"), more["len"].alias("grown"), lattice.compare_growable(a, b).alias("compared"))


_VECTORS = "x AS (SELECT l_orderkey AS k, list(l_suppkey % 4 ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem GROUP BY l_orderkey)"


@_query(f"WITH {_VECTORS} SELECT k, {_text('a || list_filter(b, lambda y, i: NOT list_contains(a, y) AND list_position(b, y) = i)')} AS joined, {_text('list_filter(a, lambda y, i: list_contains(b, y) AND list_position(a, y) = i)')} AS met, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS compared FROM x")
def vector_lattice(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: c(x))
    x = rows.groupBy(F.col("l_orderkey").alias("k")).agg(ordered(lambda x: x["l_suppkey"] % 4).alias("a"), ordered(lambda x: x["l_partkey"] % 5).alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select("k", _listed(lattice.join_vectors(a, b)).alias("joined"), _listed(lattice.meet_vectors(a, b)).alias("met"), lattice.compare_vectors(a, b).alias("compared"))


@_query("SELECT c_custkey AS k, (c_acctbal > 0) OR (c_nationkey > 12) AS joined, (c_acctbal > 0) AND (c_nationkey > 12) AS met, (c_acctbal > 0)::INT - (c_nationkey > 12)::INT AS compared FROM customer")
def truth_lattice(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    a, b = F.col("c_acctbal") > 0, F.col("c_nationkey") > 12
    return c.select(F.col("c_custkey").alias("k"), lattice.join_truth(a, b).alias("joined"), lattice.meet_truth(a, b).alias("met"), lattice.compare_truth(a, b).alias("compared"))


@_query("SELECT DISTINCT l_partkey AS k, l_linenumber AS e FROM lineitem")
def join_of_all(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("e"))
    return lattice.join_all(rows, "k", "e")


@_query("WITH s AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey % 10) AS n FROM lineitem GROUP BY l_orderkey) SELECT k, (10 - n)::BIGINT AS zeros, n AS ones FROM s")
def bit_array_complement(spark, d):
    bits = lattice.bit_sets(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 10).alias("bit")), "k", "bit")
    return bits.select("k", F.size(lattice.complement(F.col("bits"), F.lit(10))).cast("long").alias("zeros"), F.size("bits").cast("long").alias("ones"))


@_query("WITH s AS (SELECT DISTINCT l_partkey AS k, l_linenumber AS e, l_returnflag AS g FROM lineitem), n AS (SELECT k, count(DISTINCT g) AS n FROM s GROUP BY k) SELECT k, e FROM s JOIN n USING (k) GROUP BY k, e, n HAVING count(*) = n")
def meet_of_all(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("e"), F.col("l_returnflag").alias("g"))
    return lattice.meet_all(rows, "k", "g", "e")


_ZONE = "z AS (SELECT l_orderkey AS k, l_linenumber AS line, l_quantity::INT * 2 + 1 AS ub, (l_partkey % 40)::INT * 2 AS db, (-(l_suppkey % 30))::INT * 2 + 1 AS lb, (l_linenumber * 6)::INT * 2 + 1 AS yb FROM lineitem)"


def _bounds(spark, d):
    """For each line item packed bounds: x - 0 <= quantity, x - y < part % 40, 0 - y <= -(supplier % 30), y - 0 <= 6 * line."""
    weak, strict = (lambda c: c.cast("int") * 2 + 1), (lambda c: c.cast("int") * 2)
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), weak(F.col("l_quantity")).alias("ub"), strict(F.col("l_partkey") % 40).alias("db"), weak(-(F.col("l_suppkey") % 30)).alias("lb"), weak(F.col("l_linenumber") * 6).alias("yb"))


def _open_zones(spark, d):
    zone = zones.tighten_each(zones.new_zone(3), {(1, 0): F.col("ub"), (1, 2): F.col("db"), (0, 2): F.col("lb"), (2, 0): F.col("yb")}, 3)
    return _bounds(spark, d).select("k", "line", zone.alias("zone"))


def _zones(spark, d):
    return zones.closed(_open_zones(spark, d), 3).drop("overflow")


def _live_zones(spark, d):
    return _zones(spark, d).filter(zones.is_consistent(F.col("zone"), 3))


def _add(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = 32767 OR {b} = 32767 THEN 32767 ELSE (({a} >> 1) + ({b} >> 1)) * 2 + ({a} & {b} & 1) END)"


def _beyond(a: str, b: str) -> str:
    return f"({a} <> 32767 AND {b} <> 32767 AND (NOT ({a} >> 1) + ({b} >> 1) BETWEEN -16384 AND 16383 OR {_add(a, b)} = 32767))"


def _closed_sql(scale: int = 1, source: str = "z") -> str:
    cells = {(i, j): "1" if i == 0 or i == j else "32767" for i in range(3) for j in range(3)}
    cells |= {(1, 0): "ub", (1, 2): "db", (0, 2): "least(1, lb)", (2, 0): "yb"}
    out = "c0 AS (SELECT k, line, false AS beyond, " + ", ".join(f"{e} AS m{i}{j}" for (i, j), e in cells.items()) + f" FROM {source})"
    for p in range(3):
        out += f", c{p + 1} AS (SELECT k, line, beyond OR " + " OR ".join(_beyond(f"m{i}{p}", f"m{p}{j}") for i, j in cells) + " AS beyond, " + ", ".join(f"least(m{i}{j}, {_add(f'm{i}{p}', f'm{p}{j}')}) AS m{i}{j}" for i, j in cells) + f" FROM c{p})"
    return out


_CLOSED = f"WITH {_ZONE}, {_closed_sql()}"
_OK = "(m00 >= 1 AND m11 >= 1 AND m22 >= 1)"
_ALL = [f"m{i}{j}" for i in range(3) for j in range(3)]


def _cells(zone, names=tuple(_ALL)):
    return [zone.getItem(i).cast("int").alias(n) for i, n in enumerate(names)]


def _where_consistent(rows):
    ok = F.col("consistent")
    return rows.select("k", "line", "consistent", *[F.when(ok, F.col("zone").getItem(i)).cast("int").alias(n) for i, n in enumerate(_ALL)])


_SHOWN = f"{_OK} AS consistent, " + ", ".join(f"CASE WHEN {_OK} THEN {m} END AS {m}" for m in _ALL)


@_query(f"{_CLOSED} SELECT k, line, {_SHOWN} FROM c3")
def zone_close(spark, d):
    return _where_consistent(_zones(spark, d).withColumn("consistent", zones.is_consistent(F.col("zone"), 3)))


@_query(f"WITH {_ZONE}, big AS (SELECT k, line, (ub >> 1) * 500 * 2 + 1 AS ub, (db >> 1) * 400 * 2 AS db, (lb >> 1) * 2 + 1 AS lb, (yb >> 1) * 200 * 2 + 1 AS yb FROM z WHERE (ub >> 1) * 500 <= 16383 AND (db >> 1) * 400 <= 16383), {_closed_sql(source='big')} SELECT k, line, beyond AS overflow, CASE WHEN NOT beyond THEN m00 END AS m00, CASE WHEN NOT beyond THEN m10 END AS m10 FROM c3 UNION ALL SELECT k, line, true, NULL, NULL FROM z WHERE (ub >> 1) * 500 > 16383 OR (db >> 1) * 400 > 16383")
def zone_overflow(spark, d):
    """Bounds so large that some sums leave their range; line items whose own bounds leave it have no zone."""
    z = _bounds(spark, d)
    large = lambda c, by: zones.relation(zones.bound(F.col(c)) * by, zones.is_weak(F.col(c)))
    z = z.select("k", "line", large("ub", 500).alias("ub"), large("db", 400).alias("db"), "lb", large("yb", 200).alias("yb"))
    lost = F.col("ub").isNull() | F.col("db").isNull()
    zone = zones.tighten_each(zones.new_zone(3), {(1, 0): F.col("ub"), (1, 2): F.col("db"), (0, 2): F.col("lb"), (2, 0): F.col("yb")}, 3)
    z = zones.closed(z.select("k", "line", lost.alias("lost"), F.when(~lost, zone).alias("zone")), 3)
    return z.select("k", "line", (F.col("overflow") | F.col("lost")).alias("overflow"), *_cells(F.col("zone"))[0:1], F.col("zone").getItem(3).cast("int").alias("m10"))


@_query(f"{_CLOSED} SELECT k, line, m00, m01, m02, 32767 AS m10, m11, m12, 32767 AS m20, m21, m22 FROM c3 WHERE {_OK}")
def zone_up(spark, d):
    return _live_zones(spark, d).select("k", "line", *_cells(zones.up(F.col("zone"), 3)))


@_query(f"{_CLOSED} SELECT k, line, m00, m00 AS m01, m02, m00 AS m10, 1 AS m11, m02 AS m12, m20, m20 AS m21, m22 FROM c3 WHERE {_OK}")
def zone_reset(spark, d):
    return _live_zones(spark, d).select("k", "line", *_cells(zones.reset(F.col("zone"), 1, 3)))


@_query(f"{_CLOSED} SELECT k, line, m00, m02 AS m01, m02, m20 AS m10, 1 AS m11, 1 AS m12, m20, 1 AS m21, m22 FROM c3 WHERE {_OK}")
def zone_copy_clock(spark, d):
    return _live_zones(spark, d).select("k", "line", *_cells(zones.copy_clock(F.col("zone"), 1, 2, 3)))


@_query(f"{_CLOSED} SELECT k, line, m00, {_add('m02', '-13')} AS m01, m02, {_add('m20', '15')} AS m10, 1 AS m11, 15 AS m12, m20, -13 AS m21, m22 FROM c3 WHERE {_OK}")
def zone_assign_offset(spark, d):
    """x := y + 7."""
    return _live_zones(spark, d).select("k", "line", *_cells(zones.assign_offset(F.col("zone"), 1, 2, 7, 3)))


@_query(f"{_CLOSED}, t AS (SELECT k, line, " + ", ".join(f"least({m}, {_add(_add(f'm{m[1]}2', 't'), f'm0{m[2]}')}) AS {m}" for m in _ALL) + f" FROM (SELECT *, least(m20, 9) AS t FROM c3 WHERE {_OK})) SELECT k, line, {_SHOWN} FROM t")
def zone_tighten(spark, d):
    z = _live_zones(spark, d)
    z = zones.closed_pair(z.withColumn("zone", zones.tighten(F.col("zone"), 2, 0, F.lit(9), 3)), 2, 0, 3)
    return _where_consistent(z.withColumn("consistent", zones.is_consistent(F.col("zone"), 3)))


@_query(f"{_CLOSED}, n AS (SELECT *, " + ", ".join(f"lead({m}) OVER w AS n{m}" for m in _ALL) + f", lead(line) OVER w AS other FROM c3 WHERE {_OK} WINDOW w AS (PARTITION BY k ORDER BY line, " + ", ".join(_ALL) + ")) SELECT k, line, " + " AND ".join(f"{m} <= n{m}" for m in _ALL) + " AS inside, " + " + ".join(f"least({m}, n{m})" for m in _ALL) + " AS met FROM n WHERE other IS NOT NULL")
def zone_subset_and_meet(spark, d):
    z = _live_zones(spark, d)
    z = z.withColumn("next", F.lead("zone").over(W.partitionBy("k").orderBy("line", "zone"))).filter("next is not null")
    met = F.aggregate(zones.intersect(F.col("zone"), F.col("next")), F.lit(0), lambda a, x: a + x)
    return z.select("k", "line", zones.subset(F.col("zone"), F.col("next")).alias("inside"), met.alias("met"))


_WORD = "(CASE WHEN {0} = 32767 THEN NULL ELSE '{1} ' || (CASE WHEN {0} & 1 = 1 THEN '≤' ELSE '<' END) || ' ' || ({0} >> 1) END)"
_TEXT = ", ".join(_WORD.format(f"m{i}{j}", t) for i, j, t in ((0, 1, "-x"), (1, 0, "x"), (1, 2, "x - y"), (0, 2, "-y"), (2, 0, "y"), (2, 1, "y - x")))


@_query(f"{_CLOSED} SELECT k, line, concat_ws(' && ', {_TEXT}) AS text FROM c3 WHERE {_OK}")
def zone_text(spark, d):
    return _live_zones(spark, d).select("k", "line", zones.constraint_text(F.col("zone"), ["x", "y"]).alias("text"))


@_query(f"WITH {_ZONE} SELECT k, line, {_add('ub', 'db')} AS total, (-(ub >> 1)) * 2 + 1 - (ub & 1) AS negated FROM z")
def relation_arithmetic(spark, d):
    return _bounds(spark, d).select("k", "line", zones.add(F.col("ub"), F.col("db")).alias("total"), zones.negate(F.col("ub")).alias("negated"))


@_query(f"WITH {_ZONE}, r AS (SELECT k, line, (ub >> 1) * 300 * 2 + 1 AS a, CASE WHEN line = 4 THEN 32767 ELSE (lb >> 1) * 400 * 2 END AS b FROM z), n AS (SELECT k, line, a, b, CASE WHEN b <> 32767 THEN (-(b >> 1)) * 2 + 1 - (b & 1) END AS nb FROM r) SELECT k, line, CASE WHEN {_beyond('a', 'nb')} THEN NULL ELSE {_add('a', 'nb')} END AS minus, b = 32767 OR {_beyond('a', 'nb')} AS failed FROM n")
def relation_subtraction(spark, d):
    """Where the difference leaves the range, or no bound is subtracted, there is none, and failed tells so."""
    times = lambda c, by, weak: zones.relation(zones.bound(F.col(c)) * by, F.lit(weak))
    z = _bounds(spark, d).select("k", "line", times("ub", 300, True).alias("a"), F.when(F.col("line") == 4, zones.INFINITY).otherwise(times("lb", 400, False)).alias("b"))
    minus = zones.subtract(F.col("a"), F.col("b"))
    return z.select("k", "line", minus.alias("minus"), zones.failed(minus, F.col("a"), F.col("b")).alias("failed"))


_FORMULA = "NOT ((a OR NOT b) AND (c OR (a AND NOT c))) OR (b AND (a OR c))"
_VALUES = "(SELECT p_partkey AS k, p_size > 25 AS a, p_retailprice > 1400 AS b, p_brand < 'Brand#3' AS c FROM part)"


@_query(f"SELECT k, {_FORMULA} AS given, {_FORMULA} AS nnf, {_FORMULA} AS cnf, {_FORMULA} AS dnf FROM {_VALUES}")
def formula_normal_forms(spark, d):
    a, b, c = B.name("a"), B.name("b"), B.name("c")
    f = ~((a | ~b) & (c | (a & ~c))) | (b & (a | c))
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), (F.col("p_size") > 25).alias("a"), (F.col("p_retailprice") > 1400).alias("b"), (F.col("p_brand") < "Brand#3").alias("c"))
    return part.select("k", f.column().alias("given"), B.nnf(f).column().alias("nnf"), B.cnf(f).column().alias("cnf"), B.dnf(f).column().alias("dnf"))


@_query("SELECT DISTINCT l_partkey AS v, l_orderkey AS e FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def hyperedges_incident(spark, d):
    edges = views.hyperedges(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_partkey")
    return views.incident(edges, spark.read.parquet(f"{d}/part.parquet").filter("p_size = 1").select(F.col("p_partkey").alias("v")))


@_query("SELECT l_orderkey AS e FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_suppkey = 3) AND bool_or(l_suppkey = 5)")
def hyperedge_connections(spark, d):
    return views.hyper_connections(views.hyperedges(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_suppkey"), 3, 5)


def _segments(spark, d: str) -> DataFrame:
    customers = spark.read.parquet(f"{d}/customer.parquet")
    return customers.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("property"))


@_query("WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey = 9 THEN 'SET' ELSE c_mktsegment END AS property FROM customer) SELECT k + (k >= 4)::BIGINT AS k, property FROM s UNION ALL SELECT 4, 'NEW'")
def property_set_insert(spark, d):
    return views.insert_property(views.set_property(_segments(spark, d), 9, "SET"), 4, "NEW")


@_query("SELECT c_custkey - (c_custkey > 7)::BIGINT AS k, c_mktsegment AS property FROM customer WHERE c_custkey <> 7")
def property_remove(spark, d):
    n = 1 << 40  # far past the end: nothing is inserted
    return views.insert_property(views.remove_property(_segments(spark, d), 7), n, "NEVER")


@_query(f"WITH {_ARCS} SELECT src AS state, letter, o % 3 AS clause, array_to_string(list_sort(list(DISTINCT dst)), ',') AS successors FROM arcs GROUP BY ALL")
def alternating_clauses(spark, d):
    """Transitions of a state and letter whose orders agree modulo 3 are one clause, with one or more successors."""
    each = views.clause_sets(views.conjunctive_clauses(S.order_arcs(spark, d).withColumn("group", F.col("o") % 3), "group"))
    return each.select("state", "letter", "clause", _listed(F.col("successors")).alias("successors"))


@_query(f"WITH {_ARCS}, c AS (SELECT src AS state, letter, o % 3 AS clause, bool_and(coalesce(c_acctbal > 0, false)) AS ok FROM arcs LEFT JOIN customer ON c_custkey = dst GROUP BY ALL) SELECT DISTINCT state, letter FROM c WHERE ok")
def alternating_satisfied(spark, d):
    clauses = views.conjunctive_clauses(S.order_arcs(spark, d).withColumn("group", F.col("o") % 3), "group")
    return views.clause_satisfied(clauses, S.customer_arena(spark, d).filter("balance > 0"))


@_query(f"WITH {_ARCS} SELECT src AS state, letter, o AS clause, dst AS succ FROM arcs")
def single_clauses(spark, d):
    each = views.clause_sets(views.clauses(S.order_arcs(spark, d).withColumnRenamed("o", "e")))
    return each.select("state", "letter", "clause", F.element_at("successors", 1).alias("succ"))


@_query(f"WITH {_ARCS} SELECT o, src, dst FROM arcs WHERE letter = '1'")
def transitions_under_letter(spark, d):
    return graph.under_letter(S.order_arcs(spark, d), "1").select("o", "src", "dst")


@_query(f"WITH {_ARCS} SELECT dst AS v, src AS pred, count(*) AS n FROM arcs WHERE letter = '2' GROUP BY ALL")
def incoming_under_letter(spark, d):
    return graph.incoming_under_letter(S.order_arcs(spark, d), "2").groupBy("v", "pred").agg(F.count("*").alias("n"))


@_query(f"WITH {_ARCS} SELECT DISTINCT letter FROM arcs")
def letters_in_use(spark, d):
    return graph.alphabet(S.order_arcs(spark, d))


@_query(f"WITH {_ARCS} SELECT (SELECT count(DISTINCT v) FROM (SELECT src AS v FROM arcs UNION ALL SELECT dst FROM arcs)) AS states, count(*) AS transitions, count(DISTINCT letter) AS letters FROM arcs")
def relation_size(spark, d):
    return graph.relation_size(S.order_arcs(spark, d))


@_query(f"WITH {_ARCS} SELECT (SELECT count(*) FROM customer) AS vertices, count(*) AS edges, false AS empty FROM arcs UNION ALL SELECT count(*), 0, count(*) = 0 FROM customer WHERE c_custkey < 0")
def graph_counts(spark, d):
    """Of the whole graph, and of the part with negative customer keys, which has no vertices."""
    arena, arcs = S.customer_arena(spark, d), S.order_arcs(spark, d)
    return graph.counts(arena, arcs).unionByName(graph.counts(arena.filter("v < 0"), arcs.filter("src < 0 and dst < 0")))


@_query(f"WITH {_ARCS} SELECT DISTINCT src AS v, dst AS neighbour, true AS forward FROM arcs UNION ALL SELECT DISTINCT dst, src, false FROM arcs")
def neighbours(spark, d):
    arcs = S.order_arcs(spark, d)
    return graph.neighbours(arcs).withColumn("forward", F.lit(True)).unionByName(graph.neighbours(arcs, False).withColumn("forward", F.lit(False)))


@_query(f"WITH {_ARCS} SELECT c_custkey AS src, c_nationkey AS dst, (c_custkey, c_nationkey) IN (SELECT (src, dst) FROM arcs) AS connected FROM customer")
def connects_to(spark, d):
    pairs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return graph.connects_to(pairs, S.order_arcs(spark, d))


@_query(f"WITH {_ARCS} SELECT o, src, dst, 'out' AS way FROM arcs WHERE src = 7 UNION ALL SELECT o, src, dst, 'in' FROM arcs WHERE dst = 7 UNION ALL SELECT o, dst, src, 'turned' FROM arcs")
def arc_views(spark, d):
    arcs = S.order_arcs(spark, d).select("o", "src", "dst")
    parts = ((graph.outgoing(arcs, 7), "out"), (graph.incoming(arcs, 7), "in"), (graph.reversed_arcs(arcs), "turned"))
    out = [p.select("o", "src", "dst").withColumn("way", F.lit(w)) for p, w in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query(f"WITH {_ARCS} SELECT c_custkey AS v FROM customer UNION ALL SELECT max(c_custkey) + 1 FROM customer")
def insert_vertex(spark, d):
    return graph.insert_vertex(S.customer_arena(spark, d))


@_query("SELECT a.n_nationkey::BIGINT AS src, b.n_nationkey::BIGINT AS dst FROM nation a, nation b")
def complete_graph(spark, d):
    return S.complete_arcs(spark, spark.read.parquet(f"{d}/nation.parquet").count())


@_query("WITH n AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS e FROM (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)) SELECT e, src, dst FROM n WHERE e BETWEEN 100 AND 199")
def arc_range(spark, d):
    return graph.arc_ranges(S.numbered_arcs(_supply(spark, d)), 100, 200)


def _sides(spark, d):
    return S.customer_arena(spark, d).select("v", (F.col("balance") >= 0).alias("side"))


_SIDES = "s AS (SELECT c_custkey AS v, c_acctbal >= 0 AS side FROM customer)"
_CROSSING = f"WITH {_ARCS}, {_SIDES}, x AS (SELECT o, src, dst, a.side <> b.side AS crosses FROM arcs LEFT JOIN s a ON a.v = src LEFT JOIN s b ON b.v = dst)"


@_query(f"{_CROSSING} SELECT src, dst, coalesce(crosses, false) AS taken, count(*) AS n FROM x GROUP BY ALL")
def two_sided_graph(spark, d):
    _, taken, refused = S.from_arcs_and_sides(S.order_arcs(spark, d), _sides(spark, d))
    both = taken.withColumn("taken", F.lit(True)).unionByName(refused.withColumn("taken", F.lit(False)))
    return both.groupBy("src", "dst", "taken").agg(F.count("*").alias("n"))


@_query(f"{_CROSSING} SELECT DISTINCT src, dst, NOT crosses AS same FROM x")
def same_side(spark, d):
    return graph.same_side(S.order_arcs(spark, d).select("src", "dst").distinct(), _sides(spark, d))


@_query(f"WITH {_SIDES} SELECT side, count(*) AS vertices FROM s GROUP BY side")
def side_counts(spark, d):
    return graph.side_counts(_sides(spark, d))


@_query(f"WITH {_SIDES}, m AS (SELECT max(v) + 1 AS v FROM s) SELECT v, side FROM s UNION ALL SELECT v, false FROM m UNION ALL SELECT v + 1, true FROM m")
def insert_on_side(spark, d):
    return graph.insert_on_side(graph.insert_on_side(_sides(spark, d), False), True)


@_query(f"{_CROSSING}, y AS (SELECT * FROM s UNION ALL SELECT max(v) + 1, false FROM s), t AS (SELECT o, src, dst FROM x WHERE crosses), c AS (SELECT src AS v FROM t UNION SELECT dst FROM t), p AS (SELECT (SELECT min(v) FROM y WHERE v IN (FROM c)) AS bound, (SELECT min(v) FROM y WHERE v NOT IN (FROM c)) AS free) SELECT v, CASE WHEN v = free THEN NOT side ELSE side END AS side, v = bound AS asked FROM y, p")
def move_to_side(spark, d):
    """A vertex with crossing arcs is asked to change sides and stays, one without is asked and moves; a new vertex has none."""
    sides = saved(graph.insert_on_side(_sides(spark, d), False))
    _, taken, _ = S.from_arcs_and_sides(S.order_arcs(spark, d), sides)
    taken = saved(taken)
    feasible = saved(graph.can_change_side(taken, sides))
    pick = {r.feasible: (r.v, r.side) for r in feasible.join(sides, "v").groupBy("feasible").agg(F.min("v").alias("v"), F.min_by("side", "v").alias("side")).collect()}
    for v, side in pick.values():
        sides = graph.move_to_side(sides, taken, v, not side)
    return sides.withColumn("asked", F.col("v") == pick[False][0])


@_query(f"{_CROSSING} SELECT v, CASE WHEN v = 3 THEN 'RED' ELSE 'BLUE' END AS colour FROM s")
def recolour(spark, d):
    return graph.recolour(_sides(spark, d).select("v", F.lit("BLUE").alias("colour")), 3, "RED")


@_query("SELECT l_orderkey AS e, count(*)::INT AS tail_size, count(*)::INT AS head_size, bool_or(l_partkey = 7) AS in_tail, bool_or(l_suppkey = 7) AS in_head FROM lineitem GROUP BY l_orderkey")
def hyper_contains(spark, d):
    h = saved(_hyper(spark, d))
    return graph.hyper_cardinalities(h).join(graph.hyper_contains(h, 7), "e")


@_query("SELECT l_orderkey AS e FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_partkey % 50 = 7 AND l_partkey = 7) AND bool_or(l_suppkey IS NOT NULL AND l_suppkey = 4)")
def hyper_arcs_between(spark, d):
    return graph.hyper_arcs_between(_hyper(spark, d), 7, 4)


@_query(f"{_SCC} SELECT v FROM c WHERE class = (SELECT class FROM c WHERE v = 2)")
def class_members(spark, d):
    return R.members(_classes(spark, d), 2)


@_query(f"{_SCC} SELECT DISTINCT src, dst, coalesce(a.class = b.class, false) AS connected FROM u LEFT JOIN c a ON a.v = src LEFT JOIN c b ON b.v = dst")
def strongly_connected(spark, d):
    arcs = _layers(spark, d)
    return R.strongly_connected(arcs.select("src", "dst").distinct(), _classes(spark, d))


@_query(f"{_SCC}, k AS (SELECT count(*) AS n FROM c GROUP BY class) SELECT count(*) AS classes, sum(n)::BIGINT AS members, max(n) AS largest FROM k")
def class_sizes(spark, d):
    return R.class_sizes(_classes(spark, d))


_FIRST = "f AS (SELECT src AS v, arg_min(dst, o) AS succ FROM arcs GROUP BY src)"


def _first_successors(spark, d):
    arcs = S.order_arcs(spark, d)
    return arcs.groupBy(F.col("src").alias("v")).agg(F.min_by("dst", "o").alias("succ"))


@_query(f"WITH RECURSIVE {_ARCS}, {_FIRST}, p(start, pos, v, seen) AS (SELECT c_custkey, 0::BIGINT, c_custkey, [c_custkey] FROM customer UNION ALL SELECT start, pos + 1, f.succ, seen || [f.succ] FROM p JOIN f ON f.v = p.v WHERE len(list_distinct(seen)) = len(seen)) SELECT start, pos, v FROM p")
def strategy_plays(spark, d):
    """From every customer the play that always takes the first order."""
    return games.plays(S.customer_arena(spark, d), _first_successors(spark, d))


@_query(f"WITH {_ARCS}, {_FIRST} SELECT v, succ FROM f WHERE v NOT IN (4, 5) UNION ALL SELECT 4, 9")
def strategy_edits(spark, d):
    return games.remove_choice(games.insert_choice(_first_successors(spark, d), 4, 9), 5)


@_query(f"WITH RECURSIVE {_ARCS}, f AS (SELECT src AS v, arg_min(dst, o) AS a, arg_max(dst, o) AS b FROM arcs GROUP BY src), p(start, pos, v, memory, seen) AS (SELECT c_custkey, 0::BIGINT, c_custkey, 0::BIGINT, [c_custkey * 2] FROM customer UNION ALL SELECT start, pos + 1, y, m, seen || [y * 2 + m] FROM (SELECT p.*, CASE WHEN memory = 0 THEN a ELSE b END AS y, CASE WHEN y % 10 = 0 THEN 1 - memory ELSE memory END AS m FROM p JOIN f ON f.v = p.v WHERE len(list_distinct(seen)) = len(seen))) SELECT start, pos, v, memory FROM p")
def memory_plays(spark, d):
    """Takes the first order under memory 0 and the last under 1; memory changes at vertices that end in 0."""
    arcs = S.order_arcs(spark, d)
    both = arcs.groupBy(F.col("src").alias("v")).agg(F.min_by("dst", "o").alias("a"), F.max_by("dst", "o").alias("b"))
    choices = both.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("memory"), "v", F.col("a").alias("succ")), F.struct(F.lit(1).cast("long").alias("memory"), "v", F.col("b").alias("succ")))).alias("x")).select("x.*")
    ends = arcs.select(F.col("dst").alias("v")).distinct().filter("v % 10 = 0")
    updates = ends.select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("memory"), "v").withColumn("next", 1 - F.col("memory"))
    return games.plays_with_memory(S.customer_arena(spark, d), choices, updates)
