"""Boolean formulas: normal forms on small trees, compiled to column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Formula:
    """kind: value (args: a bool), name (args: a column name), not, and, or."""

    kind: str
    args: tuple

    def __and__(self, other: Formula) -> Formula:
        return conjunction([*self._parts("and"), *other._parts("and")])

    def __or__(self, other: Formula) -> Formula:
        return disjunction([*self._parts("or"), *other._parts("or")])

    def __invert__(self) -> Formula:
        return Formula("not", (self,))

    def _parts(self, kind: str) -> tuple:
        return self.args if self.kind == kind else (self,)

    def column(self) -> Column:
        if self.kind == "value":
            return F.lit(self.args[0])
        if self.kind == "name":
            return F.col(self.args[0])
        inner = [x.column() for x in self.args]
        if self.kind == "not":
            return ~inner[0]
        return reduce((lambda a, b: a & b) if self.kind == "and" else (lambda a, b: a | b), inner, F.lit(self.kind == "and"))


def text(f: Formula) -> str:
    """T, F, names, ! before what is negated, & and | between parts, nested ones in brackets."""
    if f.kind == "value":
        return "T" if f.args[0] else "F"
    if f.kind == "name":
        return f.args[0]
    if f.kind == "not":
        inner = text(f.args[0])
        return f"!{inner}" if f.args[0].kind in ("value", "name", "not") else f"!({inner})"
    parts = [text(x) if x.kind in ("value", "name", "not") else f"({text(x)})" for x in f.args]
    return (" & " if f.kind == "and" else " | ").join(parts)


def disjuncts(f: Formula) -> tuple[Formula, ...] | None:
    """The parts of a disjunction; None for other formulas."""
    return f.args if f.kind == "or" else None


def conjuncts(f: Formula) -> tuple[Formula, ...] | None:
    return f.args if f.kind == "and" else None


def negated(f: Formula) -> Formula | None:
    """What a negation negates; None for other formulas."""
    return f.args[0] if f.kind == "not" else None


def embed(value: bool) -> Formula:
    return Formula("value", (value,))


def name(column: str) -> Formula:
    return Formula("name", (column,))


def _join(kind: str, parts: list[Formula]) -> Formula:
    return embed(kind == "and") if not parts else parts[0] if len(parts) == 1 else Formula(kind, tuple(parts))


def conjunction(parts: list[Formula]) -> Formula:
    return _join("and", parts)


def disjunction(parts: list[Formula]) -> Formula:
    return _join("or", parts)


def de_morgan(f: Formula) -> Formula:
    """One level: a negated conjunction or disjunction becomes its dual of negations."""
    if f.kind == "not" and f.args[0].kind in ("and", "or"):
        inner = f.args[0]
        return _join("or" if inner.kind == "and" else "and", [~x for x in inner.args])
    return f


def nnf(f: Formula) -> Formula:
    """Negations at leaves only; negated constants stay."""
    if f.kind == "not":
        inner = f.args[0]
        return nnf(inner.args[0]) if inner.kind == "not" else nnf(de_morgan(f)) if inner.kind in ("and", "or") else f
    return _join(f.kind, [nnf(x) for x in f.args]) if f.kind in ("and", "or") else f


def clauses(f: Formula, outer: str = "and") -> list[tuple[Formula, ...]]:
    """The clauses of the conjunctive (or, with outer="or", the disjunctive) normal form, without repeats."""
    f = nnf(f)
    if f.kind == outer:
        return list(dict.fromkeys(c for x in f.args for c in clauses(x, outer)))
    if f.kind in ("and", "or"):
        return list(dict.fromkeys(tuple(dict.fromkeys(sum(choice, ()))) for choice in product(*(clauses(x, outer) for x in f.args))))
    return [(f,)]


def cnf(f: Formula) -> Formula:
    return conjunction([disjunction(list(c)) for c in clauses(f, "and")])


def dnf(f: Formula) -> Formula:
    return disjunction([conjunction(list(c)) for c in clauses(f, "or")])
