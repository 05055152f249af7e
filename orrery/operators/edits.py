"""Many edits of a numbered multigraph at once: insertions and removals in sequence, each of which shifts the ids that
later ones speak of.

A chunk of edits is resolved against the ids before the chunk: how many arcs lie before each insertion is counted over
the cluster, and the ids that removals mean follow from the edits before them by order statistics, on the chunk's own
few positions. Then one pass over the arcs applies all of the chunk: arcs move by the removals and insertions below
them. So n edits take n / CHUNK passes, and what tasks are sent is bounded by the chunk."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.fixpoint import delete, latest, saved
from orrery.sources.graphs import numbered

CHUNK = 250_000


def resolve(edits: list[tuple[str, int | None, int | None, int | None]], gaps: dict[int, int], size: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(ids removed, arcs inserted (gap, src, dst)), both in order, in terms of the ids before the edits
    (kind, e, src, dst): gaps has the number of arcs up to each inserted source, size the number of all arcs."""
    removed: list[int] = []
    added: list[tuple[int, int, int, int]] = []  # src, number of the edit, gap, dst
    gone_below = lambda r: bisect_left(removed, r)
    place = lambda j: added[j][2] - gone_below(added[j][2]) + j
    for number, (kind, e, src, dst) in enumerate(edits):
        if kind == "insert":
            insort(added, (src, number, gaps[src], dst))
            continue
        if e is None or not 0 <= e < size - len(removed) + len(added):
            continue
        before = bisect_left(range(len(added)), e, key=place)
        if before < len(added) and place(before) == e:
            del added[before]
            continue
        # The old arc with so many old arcs before it that are still there.
        rest = e - before
        insort(removed, rest + bisect_left(range(len(removed)), rest + 1, key=lambda i: removed[i] - i))
    return removed, [(gap, src, dst) for src, _, gap, dst in added]


def _gaps(arcs: DataFrame, sources: list[int]) -> dict[int, int]:
    """Arcs up to and with each of the sources (in order), counted where the arcs are."""
    keys = np.array(sources, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(keys) + 1, np.int64)
        for batch in batches:
            counts += np.bincount(np.searchsorted(keys, batch.column(0).to_numpy()), minlength=len(keys) + 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["at", "n"])

    counted = arcs.select(F.col("src").cast("long")).filter("src is not null").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(keys) + 1, np.int64)
    for r in counted:
        n[r.at] = r.n
    return dict(zip(sources, np.cumsum(n)[:-1].tolist(), strict=True))


def _applied(arcs: DataFrame, edits: list, size: int) -> tuple[DataFrame, int]:
    gaps = _gaps(arcs, sorted({src for kind, _, src, _ in edits if kind == "insert"}))
    removed, added = resolve(edits, gaps, size)
    gone, gap = np.array(removed, np.int64), np.array([g for g, _, _ in added], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("e").to_numpy()
            below = np.searchsorted(gone, e)
            kept = np.flatnonzero(gone[np.minimum(below, len(gone) - 1)] != e) if len(gone) else np.arange(len(e))
            moved = e[kept] - below[kept] + np.searchsorted(gap, e[kept], "right")
            rest = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([pa.array(moved), rest.column("src"), rest.column("dst")], ["e", "src", "dst"])

    old = arcs.mapInArrow(run, "e long, src long, dst long")
    places = gap - np.searchsorted(gone, gap) + np.arange(len(gap))
    ends = [pa.array([a[k] for a in added], pa.int64()) for k in (1, 2)]
    new = arcs.sparkSession.createDataFrame(pa.table([pa.array(places, pa.int64()), *ends], ["e", "src", "dst"]), "e long, src long, dst long")
    return saved(old.unionByName(new)), size - len(removed) + len(added)


def edited(arcs: DataFrame, edits: DataFrame, vertices: int, chunk: int = CHUNK) -> DataFrame:
    """arcs (e, src, dst), numbered 0, 1, ... in order of src, after the edits (t, kind, e, src, dst) in order of t.

    `insert` adds src -> dst last among src's own arcs and moves later ids up; `remove` takes out the arc with the id e at
    that time and moves later ids down. Insertions at vertices outside 0 .. vertices - 1 and removals of ids that do not
    exist change nothing. Edits of equal t are taken by kind, e, src and dst."""
    spark = arcs.sparkSession
    arcs = saved(arcs.select(*(F.col(c).cast("long").alias(c) for c in ("e", "src", "dst"))))
    place = latest(spark)
    fits = (F.col("kind") == "remove") | (F.col("src").between(0, vertices - 1) & F.col("dst").between(0, vertices - 1))
    listed = saved(numbered(edits.select("t", "kind", "e", "src", "dst").filter(fits).withColumnRenamed("e", "of"), ["t", "kind", "of", "src", "dst"], "turn"))
    size, n = arcs.count(), listed.count()
    for at in range(0, n, chunk):
        rows = listed.filter((F.col("turn") >= at) & (F.col("turn") < at + chunk)).orderBy("turn").select("kind", "of", "src", "dst").toArrow()
        arcs, size = _applied(arcs, list(zip(*(c.to_pylist() for c in rows.columns), strict=True)), size)
        # The arcs before the chunk are read no more.
        delete(spark, place)
        place = latest(spark)
    return arcs
