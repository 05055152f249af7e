"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: a segment covers some megabytes of whole documents and stores its terms, as
words, and for each the sorted positions at which it occurs. Terms are compared by their bytes, so matches are exact. A phrase query starts from the positions of the
phrase's rarest term in the segment, shifted back by the term's place in the phrase, and intersects them with
the shifted lists of the other terms in order of rarity. Nothing is shuffled to build or search the index; it is
a Parquet table in the shared folder, so a lost executor costs one segment's work. Benchmark items are sent to
the tasks in blocks of bounded bytes, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import kernels as K
from orrery.llm.storage import written

WINDOW = 10
#: Bytes of benchmark text that are sent to tasks at once.
BLOCK_BYTES = 8 << 20
#: Candidate places of windows that a task looks at together.
CANDIDATES = 1 << 20
#: Rows of the index are megabytes each. Left alone, Parquet looks at sizes every 100 rows, so that one page holds a
#: whole file, which writers and readers then have in memory several times.
PAGES = {"parquet.page.row.count.limit": 1, "parquet.block.row.count.limit": 2}
_SEGMENT = "segment long, ids array<long>, first array<int>, terms binary, ends binary, begins binary, positions binary"
_FOUND = "segment long, row int, item_id long, start int, stop int"


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Segments of postings of all words (ASCII lower-cased) of whole texts. Null texts have no words; null keys
    and repeated rows are documents like others. An empty table has no segment."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in K.slices(batch):
                if not part.num_rows:
                    continue
                words = K.words_of(part.column("text"), K.ALNUM, lower=True, hashes=False)
                terms, term = K.distinct_words(words.data, words.starts, words.ends)
                order = np.argsort(term, kind="stable")
                begins = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
                raw, ends = K.text_bytes(terms)
                row = [number, part.column("key").to_pylist(), words.first.tolist(), raw.tobytes(), ends.astype(np.uint32).tobytes(), begins.astype(np.uint32).tobytes(), order.astype(np.uint32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 4), strict=True)], ["segment", "ids", "first", "terms", "ends", "begins", "positions"])
                number += 1

    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(K.tidy(segments), _SEGMENT)


def indexed_documents(index: DataFrame) -> DataFrame:
    """(segment, row, doc_id, n_words) of every document of the index."""
    each = index.select("segment", "first", F.posexplode("ids").alias("row", "doc_id"))
    return each.select("segment", "row", "doc_id", (F.element_at("first", F.col("row") + 2) - F.element_at("first", F.col("row") + 1)).cast("long").alias("n_words"))


class Phrases:
    """Windows of a block of items: `window` consecutive words, or all words of an item with fewer."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        column = pa.array([t for _, t in items], pa.large_string())
        words = K.words_of(column, K.ALNUM, lower=True, hashes=False)
        self.terms, index = K.distinct_words(words.data, words.starts, words.ends)
        #: Owners are numbers in the list of different item ids, of which null may be one.
        self.ids = list(dict.fromkeys(item for item, _ in items))
        number = {item: i for i, item in enumerate(self.ids)}
        begins, sizes, owners = [], [], []
        for i, (item, _) in enumerate(items):
            at, to = int(words.first[i]), int(words.first[i + 1])
            for b in range(at, max(at + 1, to - window + 1)) if to > at else ():
                begins.append(b)
                sizes.append(min(window, to - at))
                owners.append(number[item])
        self.sizes, self.owners = np.array(sizes, np.int64), np.array(owners, np.int64)
        self.table = np.full((len(begins), window), -1, np.int64)
        for j in range(window):
            has = self.sizes > j
            self.table[has, j] = index[np.array(begins, np.int64)[has] + j]


class Segment:
    """The postings of one row of the index, limited to the query's terms."""

    def __init__(self, row: dict, query: Phrases):
        self.number, self.first = row["segment"], np.array(row["first"], np.int64)
        begins = np.frombuffer(row["begins"], np.uint32).astype(np.int64)
        positions = np.frombuffer(row["positions"], np.uint32)
        ends = np.frombuffer(row["ends"], np.uint32).astype(np.int64)
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(row["terms"])])
        at = pc.index_in(query.terms, value_set=terms)
        there = at.is_valid().to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy()
        size = np.where(there, begins[at + 1] - begins[at], 0) if len(terms) else np.zeros(len(query.terms), np.int64)
        self.size, self.begin = size, np.concatenate([[0], np.cumsum(size)])
        total = int(self.begin[-1])
        source = np.repeat(begins[at] if len(terms) else np.zeros(len(at), np.int64), size) + np.arange(total) - np.repeat(self.begin[:-1], size)
        self.positions = positions[source].astype(np.int64)
        #: Sorted, as terms ascend and each term's positions do.
        self.keys = (np.repeat(np.arange(len(size)), size) << 32) | self.positions

    def candidates(self, query: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows all of whose terms occur: window, place of its rarest term, and that term's positions, flattened, in
        blocks of at most CANDIDATES, however often the rarest terms occur."""
        counts = np.where(query.table >= 0, self.size[query.table], np.iinfo(np.int64).max)
        place = counts.argmin(1) if counts.size else np.zeros(0, np.int64)
        least = counts[np.arange(len(place)), place]
        live = np.flatnonzero(least > 0)
        ends = np.cumsum(least[live])
        first = self.begin[query.table[live, place[live]]] - (ends - least[live])
        total = int(ends[-1]) if len(ends) else 0
        for begin in range(0, total, CANDIDATES):
            flat = np.arange(begin, min(total, begin + CANDIDATES))
            own = np.searchsorted(ends, flat, "right")
            yield live[own], place[live[own]], self.positions[first[own] + flat]

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term has a position in low..high."""
        at = np.searchsorted(self.keys, (term << 32) | np.maximum(low, 0))
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] <= ((term[ok] << 32) | high[ok])
        return ok

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def exact(self, query: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Occurrences of windows inside one document: window, first and last word + 1, in blocks."""
        rarity = None
        for window, place, position in self.candidates(query):
            start = position - place
            stop = start + query.sizes[window]
            ok = (start >= 0) & (stop <= self.first[-1])
            ok[ok] = self.doc_of(start[ok]) == self.doc_of(stop[ok] - 1)
            window, start = window[ok], start[ok]
            if rarity is None:
                rarity = np.argsort(np.where(query.table >= 0, self.size[query.table], np.iinfo(np.int64).max), axis=1, kind="stable")
            for j in range(1, query.table.shape[1]):
                if not len(window):
                    break
                at = rarity[window, j]
                term = query.table[window, at]
                ok = (term < 0) | self.has(np.maximum(term, 0), start + at, start + at)
                window, start = window[ok], start[ok]
            yield window, start, start + query.sizes[window]

    def near(self, query: Phrases, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places where all terms of a window lie, in any order, within `slop` words of its rarest one, in blocks."""
        for window, _, position in self.candidates(query):
            doc = self.doc_of(position)
            low = np.maximum(position - slop, self.first[doc])
            high = np.minimum(position + slop, self.first[doc + 1] - 1)
            ok = np.ones(len(window), bool)
            for j in range(query.table.shape[1]):
                term = query.table[window, j]
                ok &= (term < 0) | self.has(np.maximum(term, 0), low, high)
            yield window[ok], low[ok], high[ok] + 1


def _merged(items: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Overlapping and touching spans of one item in one document become one."""
    order = np.lexsort((start, doc, items))
    items, doc, start, stop = items[order], doc[order], start[order], stop[order]
    if not len(items):
        return [items, doc, start, stop]
    group = np.concatenate([[0], np.cumsum((items[1:] != items[:-1]) | (doc[1:] != doc[:-1]))])
    reach = np.maximum.accumulate(stop + (group << 40)) - (group << 40)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return [items[at], doc[at], start[at], np.append(reach[at[1:] - 1], reach[-1])]


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, text: str = "text", key: str = "item_id") -> DataFrame:
    """(segment, row, item_id, start, stop): word spans of documents in which windows of an item occur, exactly
    or, with a slop, in proximity. Items without words match nothing; items whose id is null match under null;
    repeated items match alike."""
    spark = index.sparkSession
    items = items.select(F.col(f"`{key}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    out = None
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        query = spark.sparkContext.broadcast(Phrases([tuple(r) for r in part.distinct().collect()], window))

        def search(batches: Iterator[pa.RecordBatch], query=query) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = Segment(batch.slice(i, 1).to_pylist()[0], query.value)
                    spans = [[np.zeros(0, np.int64)] * 4]
                    for found, start, stop in segment.exact(query.value) if slop is None else segment.near(query.value, slop):
                        spans.append(_merged(query.value.owners[found], segment.doc_of(start), start, stop))
                    item, doc, start, stop = _merged(*(np.concatenate(x) for x in zip(*spans, strict=True)))
                    base = segment.first[doc]
                    names = pa.array([query.value.ids[k] for k in item.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), segment.number), pa.int64()), pa.array(doc, pa.int32()), names, pa.array(start - base, pa.int32()), pa.array(stop - base, pa.int32())], ["segment", "row", "item_id", "start", "stop"])

        found = index.select("segment", "first", "terms", "ends", "begins", "positions").mapInArrow(K.tidy(search), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document of docs (doc_id, text): n_words, n_hit, the ids of items that occur and where (spans).

    One row for each row of docs, whose other columns are left aside; null keys and repeated rows are documents like
    others. Words that items without an id hit count, but such items are not listed. No documents, no rows; no items,
    no hits."""
    index = written(build_index(docs), "postings", PAGES)
    found = matches(index, items, window)
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "stop"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], x["stop"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    hits = found.groupBy("segment", "row").agg(covered.alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.collect_list(F.struct("item_id", "start", "stop")).alias("spans"))
    none = F.array().cast("array<string>")
    out = indexed_documents(index).join(hits, ["segment", "row"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), "spans")


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
