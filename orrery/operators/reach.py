"""Reachability, strongly connected components, condensation and emptiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import bounded
from orrery.plans.fixpoint import grow, saved, settle
from orrery.plans.skew import unique_join
from orrery.sources.graphs import numbered


def reach(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """(v, depth): least number of arcs from a start vertex (v)."""
    pairs = saved(arcs.select("src", "dst").distinct())
    seed = start.select(F.col("v").cast("long").alias("v"), F.lit(0).cast("long").alias("depth"))
    ahead = lambda delta, n: delta.select(F.col("v").alias("src")).join(pairs, "src").select(F.col("dst").alias("v"), F.lit(n).cast("long").alias("depth"))
    return grow(seed, ahead, ["v"])


def reached(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """(v): the start vertices (v) and those that they lead to, null ones aside; in one task where the graph fits it."""
    arcs = saved(arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna())
    start = start.select(F.col("v").cast("long").alias("v")).filter("v is not null").distinct()
    every = saved(arcs.select(F.explode(F.array("src", "dst")).alias("v")).unionByName(start).distinct())
    n = every.count()
    if not bounded.fits(n + 1, arcs.count() + n):
        return reach(arcs, start).select("v")
    ids = bounded.numbers(every)
    # One more vertex leads to all starts.
    begun = ids.join(start, "v", "left_semi").select(F.lit(n).cast("long").alias("i"), F.col("i").alias("j"))
    found = bounded.solved(bounded.between(ids, arcs).unionByName(begun), n + 1, bounded.depths)
    return ids.join(found, "i", "left_semi").select("v")


def components(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """(v, class): strongly connected components, named by their least member. Null vertices and arcs with a null end
    are left out; an arc's end that is not listed as a vertex is none. Repeated rows count once.

    Vertices without arcs on one side are peeled off. Vertices with one successor only are followed to where their paths
    end, by jumps of doubling length, and leave the graph, their arcs led on to that end; so long chains and
    circles take rounds by the logarithm of their length. In what is left each round settles the least label that reaches
    every vertex, labels jumping over labels: a vertex with its own label is the least of its component, and what
    reaches it among vertices of its label is that component. Labels are drawn by a hash, and arcs between vertices of
    different labels lie in no component and go, so rounds are expected to halve what is connected. Contracted vertices
    are placed at the end.

    As soon as what is left fits one task, it is finished there."""
    left = saved(vertices.select(F.col("v").cast("long").alias("v")).filter("v is not null").distinct())
    pairs = arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst")
    if bounded.fits(left.count(), pairs.count()):
        return _bounded_components(left, pairs)
    pairs = pairs.distinct()
    pairs = saved(pairs.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi"))
    found, chains = [], []
    while not left.isEmpty():
        ends = pairs.select(F.col("src").alias("v")).intersect(pairs.select(F.col("dst").alias("v")))
        done = saved(left.join(ends, "v", "left_anti").select("v", F.col("v").alias("class")))
        left, pairs = _without(left, pairs, done)
        found.append(done)
        if left.isEmpty():
            break
        if bounded.fits(left.count(), pairs.count()):
            found.append(_bounded_components(left, pairs))
            break
        single = saved(pairs.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("to"), F.count("*").alias("n")).filter("n = 1").select("v", "to"))
        if not single.isEmpty():
            chain, done = _contract(pairs, single)
            chains.append(chain)
            found.append(done)
            left = saved(left.join(single.select("v"), "v", "left_anti"))
            pairs = chain["pairs"]
        done, pairs = _labelled_components(left, pairs)
        found.append(done)
        left, pairs = _without(left, pairs, done)
        if len(found) > 8:
            found = [saved(_union(found))]
    classes = _union(found) if found else left.select("v", F.col("v").alias("class"))
    for chain in reversed(chains):
        classes = saved(classes.unionByName(_placed(chain, saved(classes))))
    names = classes.groupBy("class").agg(F.min("v").alias("name"))
    return unique_join(classes, names, "class").select("v", F.col("name").alias("class"))


def _bounded_components(left: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v, class) of a graph that fits one task, by the least members."""
    ids = bounded.numbers(left)
    least = bounded.solved(bounded.between(ids, pairs), ids.count(), bounded.least_members)
    moved = least.join(ids, "i").select("v", F.col("value").alias("i")).join(ids.withColumnRenamed("v", "least"), "i").select("v", "least")
    return saved(ids.select("v").join(moved, "v", "left").select("v", F.coalesce("least", "v").alias("class")))


def _without(left: DataFrame, pairs: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    if done.isEmpty():
        return left, pairs
    gone = done.select("v")
    left = saved(left.join(gone, "v", "left_anti"))
    return left, saved(pairs.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti"))


def _contract(pairs: DataFrame, single: DataFrame) -> tuple[dict, DataFrame]:
    """The graph without the vertices in single (v, to), and the classes of those that lead into a circle of such vertices."""
    own = single.select(F.col("v").alias("to"))
    jumps = [single]
    limit = max(1, single.count()).bit_length()
    while len(jumps) <= limit and not jumps[-1].join(own, "to", "left_semi").isEmpty():
        last = jumps[-1]
        further = last.select(F.col("v").alias("to"), F.col("to").alias("further"))
        jumps.append(saved(last.join(further, "to", "left").select("v", F.coalesce("further", "to").alias("to"))))
    last = jumps[-1]
    circling = saved(last.join(own, "to", "left_semi"))
    terminal = saved(last.join(circling.select("v"), "v", "left_anti"))
    # After as many steps as there are vertices all are on their circles; what is not reached then leads to one.
    if circling.isEmpty():
        done = circling.select("v", F.col("to").alias("class"))
    else:
        around = saved(circling.select(F.col("to").alias("v")).distinct())
        label = around.select("v", F.col("v").alias("class"))
        for jump in jumps:
            ahead = jump.join(around, "v", "left_semi").join(label.select(F.col("v").alias("to"), F.col("class").alias("other")), "to")
            label = saved(label.join(ahead.select("v", "other"), "v").select("v", F.least("class", "other").alias("class")))
        lone = circling.join(around, "v", "left_anti").select("v", F.col("v").alias("class"))
        done = saved(label.unionByName(lone))
    kept = pairs.join(single.select(F.col("v").alias("src")), "src", "left_anti")
    entries = saved(kept.join(terminal.select(F.col("v").alias("dst"), F.col("to").alias("end")), "dst").select(F.col("src"), F.col("dst").alias("entry"), "end"))
    direct = kept.join(single.select(F.col("v").alias("dst")), "dst", "left_anti").select("src", "dst")
    led = saved(direct.unionByName(entries.select("src", F.col("end").alias("dst"))).filter("src <> dst").distinct())
    return {"pairs": led, "entries": entries, "jumps": jumps, "terminal": terminal}, done


def _placed(chain: dict, classes: DataFrame) -> DataFrame:
    """(v, class) of the vertices of a chain: those behind an entry from the class where the chain ends are in it."""
    a, b = classes.select(F.col("v").alias("src"), F.col("class").alias("ca")), classes.select(F.col("v").alias("end"), F.col("class").alias("cb"))
    inside = chain["entries"].join(a, "src").join(b, "end").filter("ca = cb").select(F.col("entry").alias("v")).distinct()
    terminal = chain["terminal"]
    inside = saved(inside)
    if not inside.isEmpty():
        for jump in chain["jumps"]:
            ahead = inside.join(jump, "v").select(F.col("to").alias("v")).join(terminal.select("v"), "v", "left_semi")
            inside = saved(inside.unionByName(ahead).distinct())
    mark = inside.withColumn("inside", F.lit(True))
    held = terminal.select("v", F.col("to").alias("end")).join(mark, "v", "left").join(b, "end")
    return held.select("v", F.when(F.col("inside"), F.col("cb")).otherwise(F.col("v")).alias("class"))


def _labelled_components(left: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, class) of the components that hold the least label that reaches them, and the arcs inside one label."""
    # A 64-bit number and its hash stand for each other, so vertices may go by their hashes.
    drawn = lambda c: F.xxhash64(c)
    arcs = saved(pairs.select("src", "dst", drawn("src").alias("a"), drawn("dst").alias("b")))
    own = left.select(drawn("v").alias("v"))
    label = _least_labels(own.select("v", F.col("v").alias("label")), arcs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    a, b = label.select(F.col("v").alias("a"), F.col("label").alias("la")), label.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    same = saved(arcs.join(a, "a").join(b, "b").filter("la = lb").select("src", "dst", "a", "b"))
    # Backwards a component's least vertex reaches its members before any other label of theirs that is as small.
    back = _least_labels(own.select("v", F.col("v").alias("label")), same.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    inside = label.withColumnRenamed("label", "least").join(back, "v").filter("label = least").select("v", "least")
    names = left.select(F.col("v").alias("class"), drawn("v").alias("least"))
    done = saved(left.select("v", drawn("v").alias("own")).join(inside.withColumnRenamed("v", "own"), "own").join(names, "least").select("v", "class"))
    return done, same.select("src", "dst")


def _least_labels(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v, label): the least label that reaches v. Labels are vertices that reach v, so a label's own label does too."""

    def spread(s: DataFrame) -> DataFrame:
        over = pairs.join(s.withColumnRenamed("v", "src"), "src").select(F.col("dst").alias("v"), "label")
        near = s.unionByName(over).groupBy("v").agg(F.min("label").alias("label"))
        jump = s.select(F.col("v").alias("label"), F.col("label").alias("further"))
        return near.join(jump, "label").select("v", F.least("label", "further").alias("label"))

    return settle(state, spread, "v", "label")


def members(classes: DataFrame, v: int) -> DataFrame:
    """(v): the members of v's class; none if v has no class."""
    own = classes.filter(F.col("v") == v).select("class").distinct()
    return classes.join(F.broadcast(own), "class", "left_semi").select("v")


def strongly_connected(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (src, dst) with connected: whether both are in one class; false where one has none."""
    a, b = classes.select(F.col("v").alias("src"), F.col("class").alias("_a")), classes.select(F.col("v").alias("dst"), F.col("class").alias("_b"))
    return pairs.join(a, "src", "left").join(b, "dst", "left").withColumn("connected", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b")


def class_sizes(classes: DataFrame) -> DataFrame:
    """One row (classes, members, largest)."""
    return classes.groupBy("class").agg(F.count("*").alias("n")).agg(F.count("*").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.max("n").alias("largest"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recurrent(classes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(class, size, recurrent): more than one member, or a loop."""
    loops = arcs.filter("src = dst").select(F.col("src").alias("v")).distinct().withColumn("loop", F.lit(True))
    return classes.join(loops, "v", "left").groupBy("class").agg(F.count("*").alias("size"), ((F.count("*") > 1) | F.coalesce(F.bool_or("loop"), F.lit(False))).alias("recurrent"))


def condensation(classes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(src_class, dst_class): distinct arcs between components, and a loop on each recurrent one."""
    a, b = classes.select(F.col("v").alias("src"), F.col("class").alias("src_class")), classes.select(F.col("v").alias("dst"), F.col("class").alias("dst_class"))
    pairs = arcs.select("src", "dst").distinct().join(a, "src").join(b, "dst").select("src_class", "dst_class").distinct()
    loops = recurrent(classes, arcs).filter("recurrent").select(F.col("class").alias("src_class"), F.col("class").alias("dst_class"))
    return pairs.filter("src_class <> dst_class").unionByName(loops)


def buchi_nonempty(arcs: DataFrame, start: DataFrame, accepting: DataFrame) -> DataFrame:
    """(class): recurrent components reachable from start that hold an accepting state (v)."""
    there = saved(reached(arcs, start))
    inside = saved(arcs.join(there.withColumnRenamed("v", "src"), "src", "left_semi"))
    classes = saved(components(there, inside))
    live = recurrent(classes, inside).filter("recurrent").select("class")
    return classes.join(accepting.select("v").distinct(), "v", "left_semi").join(live, "class", "left_semi").select("class").distinct()


def parity_nonempty(arcs: DataFrame, start: DataFrame, priorities: DataFrame, least: bool = True, even: bool = True) -> DataFrame:
    """(priority, class): reachable recurrent components, among states of priorities no stronger than an accepted
    one, that hold that priority. States without priority (v, priority) lie on no accepted cycle.

    The graphs of all accepted priorities are laid side by side and their components found in one go, so rounds do
    not grow with their number. A state is listed once for each accepted priority that is no weaker than its own."""
    there = saved(reached(arcs, start))
    ranked = saved(priorities.filter("priority is not null").join(there, "v", "left_semi"))
    levels = [r[0] for r in ranked.filter(F.abs("priority") % 2 == (0 if even else 1)).select("priority").distinct().orderBy("priority").collect()]
    if not levels:
        return there.filter("false").select(F.lit(0).cast("long").alias("priority"), F.col("v").alias("class"))
    k = len(levels)
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias("layer"), F.lit(p).cast("long").alias("accepted")) for i, p in enumerate(levels)])
    weak = F.filter(listed, lambda x: (x["accepted"] <= F.col("priority")) if least else (x["accepted"] >= F.col("priority")))
    laid = saved(ranked.withColumn("x", F.explode(weak)).select("v", "priority", "x.layer", "x.accepted", (F.col("v") * k + F.col("x.layer")).alias("at")))
    ends = laid.select("v", "layer", "at")
    a, b = ends.withColumnsRenamed({"v": "src", "at": "a"}), ends.withColumnsRenamed({"v": "dst", "at": "b"})
    inside = saved(arcs.select("src", "dst").distinct().join(a, "src").join(b, ["dst", "layer"]).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    classes = saved(components(laid.select(F.col("at").alias("v")), inside))
    live = recurrent(classes, inside).filter("recurrent").select("class")
    holders = laid.filter("priority = accepted").select(F.col("at").alias("v"), F.col("accepted").alias("priority"))
    found = classes.join(holders, "v").join(live, "class", "left_semi")
    return found.select("priority", F.expr(f"(class - pmod(class, {k})) div {k}").alias("class")).distinct()


def class_order(classes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(class, height, number): height is the length of the longest way through other classes, and number counts the
    classes by height, so every arc between classes goes from a greater number to a lesser one.

    A class's height is the greatest over its successors of theirs and one. Each round settles classes all of whose
    successors are settled. Where one successor is left open, the height is max(m, w + its height), and such functions are
    composed by jumps of doubling length, so chains take rounds by the logarithm of their length; what remains then has
    at least two open successors."""
    a, b = classes.select(F.col("v").alias("src"), F.col("class").alias("a")), classes.select(F.col("v").alias("dst"), F.col("class").alias("b"))
    open_ = saved(arcs.select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("a <> b").select("a", "b", F.lit(1).cast("long").alias("w")).distinct())
    left = saved(classes.select("class").distinct().select(F.col("class").alias("a"), F.lit(0).cast("long").alias("m")))
    settled, chains = [], []
    n = left.count()
    if bounded.fits(n, open_.count()):
        ids = bounded.numbers(left.select(F.col("a").alias("v")))
        # Heights grow against the arcs.
        found = bounded.solved(bounded.between(ids, open_.select(F.col("b").alias("src"), F.col("a").alias("dst"))), n, bounded.heights)
        high = ids.join(found, "i", "left").select(F.col("v").alias("class"), F.coalesce("value", F.lit(0).cast("long")).alias("height"))
        return numbered(high, ["height", "class"], "number").select("class", "height", "number")
    while not left.isEmpty():
        ready = saved(left.join(open_.select("a"), "a", "left_anti"))
        settled.append(ready.select(F.col("a").alias("class"), F.col("m").alias("height")))
        left = left.join(ready.select("a"), "a", "left_anti")
        known = open_.join(ready.select(F.col("a").alias("b"), F.col("m").alias("of")), "b")
        raised = known.groupBy("a").agg(F.max(F.col("w") + F.col("of")).alias("up"))
        left = saved(left.join(raised, "a", "left").select("a", F.greatest("m", F.coalesce("up", F.lit(0))).alias("m")))
        open_ = saved(open_.join(ready.select(F.col("a").alias("b")), "b", "left_anti").groupBy("a", "b").agg(F.max("w").alias("w")))
        single = open_.groupBy("a").agg(F.count("*").alias("n"), F.first("b").alias("b"), F.first("w").alias("w")).filter("n = 1")
        jump = saved(single.join(left, "a").select("a", "b", "w", "m"))
        if jump.isEmpty():
            continue
        own = jump.select(F.col("a").alias("b"))
        while not jump.join(own, "b", "left_semi").isEmpty():
            on = jump.select(F.col("a").alias("b"), F.col("b").alias("b2"), F.col("w").alias("w2"), F.col("m").alias("m2"))
            further = jump.join(on, "b", "left").select("a", F.coalesce("b2", "b").alias("b"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.greatest("m", F.when(F.col("b2").isNotNull(), F.col("w") + F.col("m2")).otherwise(F.col("m"))).alias("m"))
            jump = saved(further)
        chains.append(jump)
        left = left.join(own.withColumnRenamed("b", "a"), "a", "left_anti")
        into = open_.join(own.withColumnRenamed("b", "a"), "a", "left_anti").join(jump.select(F.col("a").alias("b"), F.col("b").alias("end"), F.col("w").alias("w2"), F.col("m").alias("m2")), "b", "left")
        into = saved(into)
        raised = into.filter("end is not null").groupBy("a").agg(F.max(F.col("w") + F.col("m2")).alias("up"))
        left = saved(left.join(raised, "a", "left").select("a", F.greatest("m", F.coalesce("up", F.lit(0))).alias("m")))
        open_ = saved(into.select("a", F.coalesce("end", "b").alias("b"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")).groupBy("a", "b").agg(F.max("w").alias("w")))
        if len(settled) > 8:
            settled = [saved(_union(settled))]
    heights = _union(settled) if settled else classes.select("class", F.lit(0).cast("long").alias("height"))
    for jump in reversed(chains):
        ends = heights.select(F.col("class").alias("b"), F.col("height").alias("of"))
        heights = saved(heights.unionByName(jump.join(ends, "b").select(F.col("a").alias("class"), F.greatest("m", F.col("w") + F.col("of")).alias("height"))))
    return numbered(heights, ["height", "class"], "number").select("class", "height", "number")
