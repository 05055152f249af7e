"""Boolean formulas as rows (formula, node, parent, kind, label), many at a time.

kind is and, or, not, name or value; a root has no parent; label is a name, or T or F. `and`, `or` and `not` have
children, `not` one. Negations go down level by level, and clauses come up level by level: a node of the outer kind has
all clauses of its children, one of the inner kind the product of theirs, which is a join child by child. A clause that
holds another clause of its node is absorbed. A formula's clauses can double with each level; none is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orrery.functions.formula import Formula
from orrery.plans.fixpoint import grow, saved


def rows_of(formulas: dict[str, Formula]) -> list[tuple[str, int, int | None, str, str | None]]:
    """The rows of a few small formulas, as templates to join with data."""
    out = []
    for word, whole in formulas.items():
        waiting, number = [(whole, None)], 0
        while waiting:
            f, parent = waiting.pop()
            inner = f.kind in ("and", "or", "not")
            label = None if inner else ("T" if f.args[0] else "F") if f.kind == "value" else f.args[0]
            out.append((word, number, parent, f.kind, label))
            if inner:
                waiting += [(x, number) for x in f.args]
            number += 1
    return out


def combined(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """The formulas (left kind right) of those that both tables have by name. Parts of the same kind are taken up as they are:
    (a & b) & c is one `and` of three."""
    both = left.select("formula").distinct().join(right.select("formula").distinct(), "formula")
    out = both.select("formula", F.lit(-1).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("label"))
    for side, rows in enumerate((left, right)):
        rows = rows.join(both, "formula", "left_semi")
        same = rows.filter(F.col("parent").isNull() & (F.col("kind") == kind)).select("formula", F.col("node").alias("root"))
        own = lambda c: F.col(c) * 2 + side
        held = rows.join(same, "formula", "left").filter(F.col("root").isNull() | (F.col("node") != F.col("root")))
        parent = F.when(F.col("parent").isNull() | (F.col("parent") == F.col("root")), F.lit(-1)).otherwise(own("parent"))
        out = out.unionByName(held.select("formula", own("node").alias("node"), parent.cast("long").alias("parent"), "kind", "label"))
    return out


def negated(nodes: DataFrame) -> DataFrame:
    """The negations of the formulas."""
    top = nodes.select("formula").distinct().select("formula", F.lit(-1).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit("not").alias("kind"), F.lit(None).cast("string").alias("label"))
    return top.unionByName(nodes.select("formula", "node", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"), "kind", "label"))


def parts_of(nodes: DataFrame, kind: str) -> DataFrame:
    """(formula, node): the parts of formulas that are an `and`, an `or` or a negation as a whole; others have none."""
    roots = nodes.filter(F.col("parent").isNull() & (F.col("kind") == kind)).select("formula", F.col("node").alias("parent"))
    return nodes.join(roots, ["formula", "parent"], "left_semi").select("formula", "node")


def truth(found: DataFrame, values: DataFrame) -> DataFrame:
    """(formula, value) of disjunctive clauses (formula, clause) under values (formula, label, value): whether some clause's
    literals are all true. T is true and F false; a clause with a name that has no value, or a null one, is not true."""
    each = found.distinct().select("formula", F.col("clause").alias("at"), F.explode("clause").alias("literal"))
    label = F.regexp_replace("literal", "^!", "")
    known = each.select("formula", "at", label.alias("label"), F.col("literal").startswith("!").alias("turned")).join(values, ["formula", "label"], "left")
    value = F.when(F.col("label") == "T", True).when(F.col("label") == "F", False).otherwise(F.col("value"))
    good = F.coalesce(value != F.col("turned"), F.lit(False))
    return known.groupBy("formula", "at").agg(F.bool_and(good).alias("good")).groupBy("formula").agg(F.bool_or("good").alias("value"))


def negation_normal(nodes: DataFrame) -> DataFrame:
    """The formulas without negations: and and or below an odd number of them change places, names and values there are
    labelled with a `!` in front (De Morgan's laws, all formulas a level at a time). Children of a negation move up."""
    nodes = saved(nodes.select("formula", "node", "parent", "kind", "label"))
    seed = nodes.filter("parent is null").select("formula", "node", F.col("parent").alias("up"), "kind", F.lit(False).alias("negated"))
    below = nodes.select("formula", F.col("node").alias("child"), F.col("parent").alias("node"), F.col("kind").alias("of"))

    def step(new: DataFrame, _: int) -> DataFrame:
        under = F.col("kind") == "not"
        rows = new.join(below, ["formula", "node"])
        return rows.select("formula", F.col("child").alias("node"), F.when(under, F.col("up")).otherwise(F.col("node")).alias("up"), F.col("of").alias("kind"), (F.col("negated") != under).alias("negated"))

    found = grow(seed, step, ["formula", "node"]).filter("kind <> 'not'")
    turned = F.when(F.col("negated") & (F.col("kind") == "and"), "or").when(F.col("negated") & (F.col("kind") == "or"), "and").otherwise(F.col("kind"))
    label = F.when(F.col("negated"), F.concat(F.lit("!"), F.col("label"))).otherwise(F.col("label"))
    named = found.join(nodes.select("formula", "node", "label"), ["formula", "node"])
    return named.select("formula", "node", F.col("up").alias("parent"), turned.alias("kind"), label.alias("label"))


def absorbed(clauses: DataFrame) -> DataFrame:
    """(formula, node, clause) without clauses that hold another one of the same node. Clauses are sorted sets; a smaller
    one's least literal is in the larger one, so clauses meet by literals and not all with all."""
    rows = saved(clauses.distinct())
    small = rows.filter(F.size("clause") > 0).select("formula", "node", F.col("clause").alias("inner"), F.element_at("clause", 1).alias("literal"))
    each = rows.select("formula", "node", "clause", F.explode("clause").alias("literal"))
    gone = each.join(small, ["formula", "node", "literal"]).filter((F.size("inner") < F.size("clause")) & (F.size(F.array_except("inner", "clause")) == 0))
    return rows.join(gone.select("formula", "node", "clause").distinct(), ["formula", "node", "clause"], "left_anti")


def clauses(nodes: DataFrame, outer: str = "and", absorb: bool = True) -> DataFrame:
    """(formula, clause): the clauses (sorted sets of literals) of the conjunctive normal form, or of the disjunctive one
    with outer="or"."""
    tidy = absorbed if absorb else lambda rows: saved(rows.distinct())
    flat = saved(negation_normal(nodes))
    turn = F.row_number().over(W.partitionBy("formula", "parent").orderBy("node"))
    children = saved(flat.select("formula", "node", "parent", turn.alias("turn")).filter("parent is not null"))
    done = saved(flat.filter("kind in ('name', 'value')").select("formula", "node", F.array("label").alias("clause")))
    new = done
    left = saved(flat.filter("kind in ('and', 'or')").select("formula", "node", "kind"))
    roots = flat.filter("parent is null").select("formula", "node")
    while not left.isEmpty():
        ready = done.select("formula", "node").distinct().join(children, ["formula", "node"]).groupBy("formula", F.col("parent").alias("node")).agg(F.count("*").alias("ready"))
        arity = children.groupBy("formula", F.col("parent").alias("node")).agg(F.count("*").alias("arity"))
        now = saved(left.join(ready, ["formula", "node"]).join(arity, ["formula", "node"]).filter("ready = arity"))
        below = saved(done.join(children, ["formula", "node"]).select("formula", F.col("parent").alias("node"), "turn", "clause").join(now.drop("ready"), ["formula", "node"]))
        together = below.filter(F.col("kind") == outer).select("formula", "node", "clause")
        product = below.filter((F.col("kind") != outer) & (F.col("turn") == 1)).select("formula", "node", "arity", "clause")
        most = below.filter(F.col("kind") != outer).agg(F.max("arity")).first()[0] or 0
        for k in range(2, most + 1):
            more = below.filter((F.col("kind") != outer) & (F.col("turn") == k)).select("formula", "node", F.col("clause").alias("other"))
            both = product.filter(F.col("arity") >= k).join(more, ["formula", "node"]).select("formula", "node", "arity", F.array_sort(F.array_union("clause", "other")).alias("clause"))
            kept = tidy(both.select("formula", "node", "clause")).join(now.select("formula", "node", "arity"), ["formula", "node"]).select(*product.columns)
            product = saved(product.filter(F.col("arity") < k).unionByName(kept))
        new = tidy(together.unionByName(product.select("formula", "node", "clause")))
        used = now.select("formula", "node")
        left = saved(left.join(used, ["formula", "node"], "left_anti"))
        # Children's clauses are not needed any more.
        gone = children.join(used.withColumnRenamed("node", "parent"), ["formula", "parent"], "left_semi").select("formula", "node")
        done = saved(done.join(gone, ["formula", "node"], "left_anti").unionByName(new))
    return done.join(roots, ["formula", "node"], "left_semi").select("formula", "clause")
