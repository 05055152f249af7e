"""Clock zones: difference bound matrices as arrays of packed relations, row by row.

A relation is bound * 2 + (1 if weak); their order is the numbers' order, and INFINITY absorbs. The number of clocks
is known when the plan is made, so zones are edited cell by cell in plain column expressions of one row; closures, which
combine all cells n times, work on Arrow batches of zones. Nothing is shuffled. A null relation or zone gives null."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

# The least and greatest bound, the packed forms of no bound and of "at most 0".
MIN_BOUND, MAX_BOUND = -16384, 16383
INFINITY, ZERO = 32767, 1


def relation(bound: Column, weak: Column) -> Column:
    """Packed; null if the bound is out of range."""
    return F.when(bound.between(MIN_BOUND, MAX_BOUND), bound * 2 + weak.cast("int"))


def bound(raw: Column) -> Column:
    return F.when(raw != INFINITY, F.shiftright(raw, 1))


def is_weak(raw: Column) -> Column:
    return raw.bitwiseAND(F.lit(1)) == 1


def add(a: Column, b: Column) -> Column:
    """Sum of two relations; null where a finite sum is out of range or would read as no bound."""
    # The bounds add up, and the sum is weak only if both are.
    raw = a + b - a.bitwiseOR(b).bitwiseAND(F.lit(1))
    return F.when(F.greatest(a, b) == INFINITY, F.lit(INFINITY)).when(raw.between(2 * MIN_BOUND, INFINITY - 1), raw)


def negate(raw: Column) -> Column:
    """The complement's bound: -c with the other strictness; null for no bound."""
    return F.when(raw != INFINITY, relation(-F.shiftright(raw, 1), ~is_weak(raw)))


def subtract(a: Column, b: Column) -> Column:
    """a + (-b); null where b is no bound or a result is out of range."""
    return F.when(b != INFINITY, add(a, negate(b)))


def failed(result: Column, *operands: Column) -> Column:
    """Whether a checked operation on these operands (none of them null) had no result."""
    given = operands[0].isNotNull()
    for x in operands[1:]:
        given = given & x.isNotNull()
    return given & result.isNull()


def _cells(n: int, value: Callable[[int, int], Column]) -> Column:
    return F.array(*[value(i, j) for i in range(n) for j in range(n)])


def new_zone(n: int) -> Column:
    """All clocks at least 0: n counts the reference clock as well."""
    return _cells(n, lambda i, j: F.lit(ZERO if i == 0 or i == j else INFINITY))


def cell(zone: Column, i: int, j: int, n: int) -> Column:
    return zone.getItem(i * n + j)


def put(zone: Column, i: int, j: int, raw: Column, n: int) -> Column:
    return _cells(n, lambda r, c: raw if (r, c) == (i, j) else cell(zone, r, c, n))


def tighten(zone: Column, i: int, j: int, raw: Column, n: int) -> Column:
    return _cells(n, lambda r, c: F.least(cell(zone, r, c, n), raw) if (r, c) == (i, j) else cell(zone, r, c, n))


def tighten_each(zone: Column, bounds: dict[tuple[int, int], Column], n: int) -> Column:
    """All of the cells (i, j) tightened at once. Calls of tighten inside each other write the zone out again and again."""
    return _cells(n, lambda r, c: F.least(cell(zone, r, c, n), bounds[r, c]) if (r, c) in bounds else cell(zone, r, c, n))


def intersect(a: Column, b: Column) -> Column:
    """Cell by cell the least; null if the dimensions differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.least(x, y)))


def meet_of(rows: DataFrame, key: str, n: int, zone: str = "zone") -> DataFrame:
    """(key, zone): the intersection of each key's zones of n clocks: the least of each cell, which tasks find for their own
    rows first. Null zones are left out; a key that has no others has a null zone. Not closed: close it once."""
    cells = [F.min(F.get(zone, i)).alias(f"_c{i}") for i in range(n * n)]
    found = rows.groupBy(key).agg(*cells)
    return found.select(key, F.when(F.col("_c0").isNotNull(), F.array(*[F.col(f"_c{i}") for i in range(n * n)])).alias(zone))


def _fresh(rows: DataFrame, stem: str) -> str:
    while any(c.lower().startswith(stem.lower()) for c in rows.columns):
        stem = "_" + stem
    return stem


def _worked(rows: DataFrame, n: int, zone: str, over: str, work: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """rows with work done on all zones of a batch at once: (zones, n, n) integers to the same and whether each left the
    range. As one opaque step, so that later filters are not written out in terms of every cell of every pivot."""

    def run(column: pa.Array) -> pa.Array:
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        given = column.filter(pa.array(valid)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n, n)
        found, beyond = work(given)
        out, lost = np.zeros((len(column), n * n), np.int32), np.zeros(len(column), bool)
        out[valid], lost[valid] = found.reshape(-1, n * n), beyond
        cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) * n * n + 1, n * n, dtype=np.int32)), pa.array(out.ravel()), mask=pa.array(~valid | lost))
        return pa.StructArray.from_arrays([cells, pa.array(lost)], ["zone", "over"])

    step = F.arrow_udf(run, "struct<zone: array<int>, over: boolean>", ArrowUDFType.SCALAR).asNondeterministic()
    mark = _fresh(rows, "_closed")
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in (zone, over)]
    done = rows.select(*keep, step(F.col(f"`{zone}`").cast("array<int>")).alias(mark))
    return done.select(*keep, F.col(f"`{mark}`.zone").alias(zone), F.col(f"`{mark}`.over").alias(over))


def _sums(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As add, with no bound and true where a finite sum leaves the range."""
    raw = a + b - ((a | b) & 1)
    endless = np.maximum(a, b) == INFINITY
    beyond = ~endless & ((raw < 2 * MIN_BOUND) | (raw >= INFINITY))
    return np.where(endless | beyond, INFINITY, raw), beyond


def closed(rows: DataFrame, n: int, zone: str = "zone", over: str = "overflow") -> DataFrame:
    """rows with the zone in canonical form: all-pairs least sums over every pivot, after diagonals above "at most 0"
    came down to it. Where a sum leaves the range of bounds, over is true and the zone null. Columns of these two
    names are replaced; a null zone gives a null zone."""

    def work(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, lost = m.copy(), np.zeros(len(m), bool)
        for i in range(n):
            m[:, i, i] = np.minimum(m[:, i, i], ZERO)
        for k in range(n):
            total, beyond = _sums(m[:, :, k, None], m[:, None, k, :])
            m, lost = np.minimum(m, total), lost | beyond.any((1, 2))
        return m, lost

    return _worked(rows, n, zone, over, work)


def closed_pair(rows: DataFrame, i: int, j: int, n: int, zone: str = "zone", over: str = "overflow") -> DataFrame:
    """As closed, after the one cell (i, j) of a canonical zone was tightened."""

    def work(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, early = _sums(m[:, :, i], m[:, i, j, None])
        total, late = _sums(first[:, :, None], m[:, None, j, :])
        return np.minimum(m, total), early.any(1) | late.any((1, 2))

    return _worked(rows, n, zone, over, work)


def up(zone: Column, n: int) -> Column:
    return _cells(n, lambda i, j: F.lit(INFINITY) if j == 0 and i else cell(zone, i, j, n))


def copy_clock(zone: Column, to: int, of: int, n: int) -> Column:
    """Clock `to` (not the reference clock) takes the value of clock `of`; 0 resets it."""
    if to == 0:
        raise ValueError("the reference clock can't be assigned")
    if to == of:
        return zone
    as_of = lambda c: of if c == to else c
    return _cells(n, lambda i, j: F.lit(ZERO) if i != j and {i, j} == {to, of} or i == j == to else cell(zone, as_of(i), as_of(j), n))


def reset(zone: Column, clock: int, n: int) -> Column:
    return copy_clock(zone, clock, 0, n)


def assign_offset(zone: Column, to: int, of: int, delta: int, n: int) -> Column:
    """Clock `to` takes `of` + delta (to differs from of); null where a bound leaves the range."""
    if to == of and delta:
        raise ValueError("a clock can't be shifted by itself")
    moved = copy_clock(zone, to, of, n)
    shift = lambda d: F.lit(d * 2 + 1)
    value = lambda i, j: add(cell(moved, i, j, n), shift(delta if i == to else -delta)) if (i == to) != (j == to) else cell(moved, i, j, n)
    fits = F.lit(True)
    for k in range(n):
        if k != to:
            fits = fits & value(to, k).isNotNull() & value(k, to).isNotNull()
    return F.when(fits, _cells(n, value))


def subset(a: Column, b: Column) -> Column:
    """Inclusion of canonical zones."""
    return F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda x: x)


def is_consistent(zone: Column, n: int) -> Column:
    """Whether a canonical zone has a point; null for a null zone."""
    ok = cell(zone, 0, 0, n) >= ZERO
    for i in range(1, n):
        ok = ok & (cell(zone, i, i, n) >= ZERO)
    return ok


def constraint_text(zone: Column, names: list[str]) -> Column:
    """Finite constraints off the diagonal, joined by &&: clock by clock its lower bound, its upper bound, its differences."""
    n = len(names) + 1
    out = []
    for i in range(1, n):
        own = names[i - 1]
        rows = [(0, i, f"-{own}"), (i, 0, own), *((i, j, f"{own} - {names[j - 1]}") for j in range(1, n) if j != i)]
        for r, c, left in rows:
            raw = cell(zone, r, c, n)
            out.append(F.when(raw != INFINITY, F.concat(F.lit(left), F.when(is_weak(raw), " ≤ ").otherwise(" < "), bound(raw).cast("string"))))
    return F.concat_ws(" && ", *out)
