"""Periodic runs of words, and texts with them collapsed to one period.

A run is a stretch of consecutive words with smallest period q and at least max(MIN_LENGTH, MIN_EXPONENT * q) words that
no neighbouring word extends keeping that period. Each stretch of a text that may hold one is read into a suffix
automaton of its words. Along the automaton's links the sets of end positions are merged, the smaller into the larger
one, kept in order; two ends that become neighbours in the set of a state no shorter than their distance d seed a
square of period d. Ends inside a run are all seeds of its smallest period, and of no multiple of it (an end in between
would be in the same set), so seeds of one period that follow each other without a gap are a run's whole extent.

Stretches: in a run of at least max(6, 4 q) words every four words in a row recur inside the run. So words outside
stretches whose groups of four all recur in that same stretch are left out beforehand; nothing of a run is lost.
No rows are shuffled: a text is one row's work, in time n log n of its words and memory in proportion to its longest
stretch, and a lost executor's batches are simply read again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import kernels as K
from orrery.llm.prefix_trie import CRC32_SQL

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words of a group that recurs inside every run, as 4 q >= 2 q + 4 from q = 2 on and 6 >= 2 + 4.
GROUP = 4
_RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_automaton(letters: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length of the longest string, link) of each state, and the state of each prefix; state 0 is the start."""
    length, link, to = [0], [-1], [{}]
    prefix, last = [], 0
    for letter in letters:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        to.append({})
        at = last
        while at >= 0 and letter not in to[at]:
            to[at][letter] = new
            at = link[at]
        if at >= 0:
            over = to[at][letter]
            if length[over] == length[at] + 1:
                link[new] = over
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[over])
                to.append(to[over].copy())
                link[over] = link[new] = copy
                while at >= 0 and to[at].get(letter) == over:
                    to[at][letter] = copy
                    at = link[at]
        prefix.append(new)
        last = new
    return length, link, prefix


class _Ends:
    """An ordered set of end positions, in blocks of bounded size."""

    __slots__ = ("blocks", "heads", "size")
    MOST = 4096

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def add(self, x: int) -> None:
        k = max(0, bisect_left(self.heads, x) - 1)
        block = self.blocks[k]
        insort(block, x)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > self.MOST:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.heads[k : k + 1] = [block[0], block[half]]

    def beside(self, x: int) -> tuple[int | None, int | None]:
        """The members before and after the member x."""
        k = bisect_left(self.heads, x)
        if k == len(self.heads) or self.heads[k] != x:
            k -= 1
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        after = block[i + 1] if i + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def square_seeds(letters: list[int]) -> list[tuple[int, int]]:
    """(d, end): squares of period d that end there, from ends that are new neighbours in a state's set."""
    length, link, prefix = suffix_automaton(letters)
    ends: list[_Ends | None] = [None] * len(length)
    for i, state in enumerate(prefix):
        ends[state] = _Ends(i)
    # Members of a state's set that did not come with the largest set merged into it.
    fresh: dict[int, list[int]] = {}
    seeds = []
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        own, most = ends[state], length[state]
        for x in fresh.pop(state, ()):
            before, after = own.beside(x)
            if before is not None and x - before <= most:
                seeds.append((x - before, x))
            if after is not None and after - x <= most:
                seeds.append((after - x, after))
        above = link[state]
        ends[state] = None
        if above == 0:  # the empty string seeds nothing
            continue
        there = ends[above]
        if there is None:
            ends[above] = own
            continue
        if own.size > there.size:
            fresh[above] = list(there)
            ends[above], own = own, there
            there = ends[above]
            moved = fresh[above]
        else:
            moved = list(own)
            fresh.setdefault(above, []).extend(moved)
        for x in moved:
            there.add(x)
    return seeds


def runs_of(letters: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start and period."""
    seeds = square_seeds(letters)
    if not seeds:
        return []
    period, end = np.array(sorted(set(seeds)), np.int64).T
    head = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (end[1:] != end[:-1] + 1)]))
    tail = np.append(head[1:], len(end)) - 1
    q = period[head]
    start = end[head] - 2 * q + 1
    size = end[tail] - start + 1
    kept = size >= np.maximum(min_length, min_exponent * q)
    found = list(zip(start[kept].tolist(), size[kept].tolist(), q[kept].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, stop) of the stretches that may hold runs, from word hashes; words are numbered in the batch."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    group = K.grams(words.hashes, GROUP)
    at = np.flatnonzero(text[: len(group)] == text[GROUP - 1 :]) if len(group) else np.zeros(0, np.int64)
    part, before = text[at], -1
    while len(at):
        # Groups that recur in their part, and new parts where these do not follow each other.
        key = K.mix(group[at] ^ K.mix(part.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at, part = at[again], part[again]
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])])[: len(at)]
        part = np.cumsum(new) - 1
        # A run has at least MIN_LENGTH words, so that many groups.
        kept = np.bincount(part, minlength=1)[part] > MIN_LENGTH - GROUP if len(at) else np.zeros(0, bool)
        at, part = at[kept], part[kept]
        if len(at) == before:
            break
        before = len(at)
    head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(at)])
    tail = np.append(head[1:], len(at)) - 1 if len(at) else head
    return text[at[head]], at[head], at[tail] + GROUP


def runs_in(column: pa.Array, seed: int) -> tuple[K.Words, dict[int, list[tuple[int, int, int]]]]:
    """The words of the texts, and the runs (start, length, period) of those that have some."""
    words = K.words_of(column, K.NOT_SPACE, seed=seed)
    text, first, stop = stretches(words)
    inside = K.ragged(first, stop - first)
    _, code = K.distinct_words(words.data, words.starts[inside], words.ends[inside]) if len(inside) else (None, inside)
    found: dict[int, list[tuple[int, int, int]]] = {}
    at = 0
    for t, a, b in zip(text.tolist(), first.tolist(), stop.tolist(), strict=True):
        begin = a - int(words.first[t])
        runs = [(begin + s, n, q) for s, n, q in runs_of(code[at : at + b - a].tolist())]
        at += b - a
        if runs:
            found.setdefault(t, []).extend(runs)
    return words, {t: sorted(runs, key=lambda r: (r[0], r[2])) for t, runs in found.items()}


def collapse_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed_text of every row: the words
    that are in no run behind its first period, joined by a blank.

    Words are runs of bytes outside blank, tab and line ends, unchanged. Null and empty texts have no words and no runs.
    Rows are judged one by one, so repeated rows, null and repeated ids give as many rows; other columns are left
    aside; an empty table gives none."""
    seed = K.draw_seed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                words, found = runs_in(part.column("text"), seed)
                texts = []
                for i, value in enumerate(part.column("text")):
                    own = (value.as_py() or "").encode().split()
                    if i in found:
                        change = np.zeros(len(own) + 1, np.int64)
                        for start, size, q in found[i]:
                            change[start + q] += 1
                            change[start + size] -= 1
                        own = [own[p] for p in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                    texts.append(b" ".join(own).decode())
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(i, ())] for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(words.first).astype(np.int64)), pa.array(runs, _RUN), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed_text"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, _RUNS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32 of the decimal doc_id and g = h / 10, texts of n > 0 words whose h ends in 0 repeat
    the p = 1 + (n - a) / (3 + g % 8) words from word a = g % n on to their end. Rows without an id keep their text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.greatest(F.size("words"), F.lit(0)))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = collapse_runs(docs)
    # The longest run; of equal ones the first, then the one of least period.
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.withColumn("top", top).withColumn("lines", F.array_join(line, ""))
    period = -F.col("top.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("top.length") / period).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


#: Runs from pairs of equal groups of four words, which every run has at the distance of its period.
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32_SQL.format("doc_id::VARCHAR")}::BIGINT AS h FROM documents),
a AS (SELECT doc_id, w, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a, h // 10 AS g FROM d),
p AS (SELECT *, 1 + (len(w) - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, CASE WHEN planted THEN list_transform(range(len(w)), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
x AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM t),
f AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o AS g FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM f u JOIN f v ON v.doc_id = u.doc_id AND v.g = u.g AND v.i > u.i WHERE u.g IS NOT NULL),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 3 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
l AS (SELECT * FROM s WHERE length >= greatest({MIN_LENGTH}, {MIN_EXPONENT} * q)),
r AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l y WHERE y.doc_id = l.doc_id AND y.q < l.q AND y.start <= l.start AND y.start + y.length >= l.start + l.length)),
n AS (SELECT doc_id, count(*) AS n_runs, arg_max({{'start': start, 'length': length, 'period': q}}, (length, -start, -q)) AS top, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
