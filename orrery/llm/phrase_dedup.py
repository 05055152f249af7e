"""Substring dedup by repeated-phrase automata.

Of every window the words with the least hash are its anchor phrase. Phrases are counted by their keyed hashes, so no
words are shuffled for that; the hashes of those that occur more than once in the corpus go to the shards (some megabytes
of whole documents) that have them. Each shard compiles its own phrases of these hashes into one Aho-Corasick automaton
(words coded as a few letters each, so the automaton compares whole words) and streams its documents through it, which
locates every occurrence. Windows whose anchor phrase was located are the candidates (a clash of hashes would only add
some): they are compared across shards by 96 bits of two keyed hashes, the first in a shard speaking for the others, and
every window but the earliest of its kind is removed. Later copies of whole texts are known by their digests and need no
windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm import kernels as K
from orrery.llm.recurring import NO_ID, SHARD_BYTES, recurring_anchors
from orrery.llm.storage import written
from orrery.plans.skew import unique_join

WINDOW, PHRASE = 20, 4
#: Bits of the bitmap that is sent to all tasks: 1 MB, whatever the size of the corpus.
BITMAP = 1 << 23
_BASE = 128


def coded(ids: np.ndarray, distinct: int) -> tuple[str, int]:
    """Words as strings of letters of fixed length; each place has letters of its own, so matches keep to words."""
    places = 1
    while _BASE**places < distinct:
        places += 1
    letters = np.stack([ids // _BASE**j % _BASE + 0x100 + j * _BASE for j in range(places)], 1).astype("<u2")
    return letters.tobytes().decode("utf-16-le"), places


def phrase_automaton(phrases: np.ndarray, distinct: int):
    """The automaton of the phrases, given as rows of word numbers below distinct, coded like the texts that will be
    searched; None without phrases."""
    import ahocorasick

    if not len(phrases):
        return None
    code, places = coded(phrases.ravel().astype(np.int64), distinct)
    step = phrases.shape[1] * places
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for at in range(0, len(code), step):
        automaton.add_word(code[at : at + step])
    automaton.make_automaton()
    return automaton


def _phrases(words: K.Words, ids: np.ndarray, recurring: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """The anchor phrases of these texts whose hashes are in recurring (sorted), as rows of word numbers."""
    at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, own in K.per_doc(words):
        if len(own) >= window:
            hashes = K.grams(own, phrase)
            _, p = K.minimisers(hashes, window - phrase + 1)
            at.append(p + words.first[i])
            found.append(hashes[p])
    at, found = np.concatenate(at), np.concatenate(found)
    same = recurring[np.minimum(np.searchsorted(recurring, found), len(recurring) - 1)] == found
    rows = ids[at[same][:, None] + np.arange(phrase)].astype(np.int32)
    # Each phrase once, told apart by its words.
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * phrase))).ravel()
    return rows[np.unique(whole, return_index=True)[1]]


def _candidates(docs: pa.Table, recurring: np.ndarray, window: int, phrase: int, seeds: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """(id, line, position, two hashes, whether an earlier equal window is in the shard) of the shard's candidate windows."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.uint64, np.uint64, bool))
    order = np.lexsort((docs.column("line").to_numpy(), docs.column("id").to_numpy()))
    docs = docs.take(pa.array(order)).combine_chunks()
    words = K.words_of(docs.column("text").combine_chunks() if isinstance(docs.column("text"), pa.ChunkedArray) else docs.column("text"), K.NOT_SPACE, seed=seeds[0])
    dictionary, ids = K.distinct_words(words.data, words.starts, words.ends)
    automaton = phrase_automaton(_phrases(words, ids, recurring, window, phrase), len(dictionary))
    if automaton is None:
        return none
    names, lines = docs.column("id").to_numpy(), docs.column("line").to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for i, own in K.per_doc(words):
        if len(own) < window:
            continue
        code, places = coded(ids[words.first[i] : words.first[i + 1]].astype(np.int64), len(dictionary))
        ends = np.fromiter((end for end, _ in automaton.iter(code)), np.int64)
        if not len(ends):
            continue
        hashes = K.grams(own, phrase)
        located = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
        at = (ends + 1) // places - phrase
        located[at] = hashes[at]
        width = window - phrase + 1
        starts = np.flatnonzero(K.sliding(located, width) == K.sliding(hashes, width))
        if len(starts):
            whole = K.grams(own, window, seed=1)[starts]
            # The second hash is for texts with candidates only.
            begin, end = words.starts[words.first[i] : words.first[i + 1]], words.ends[words.first[i] : words.first[i + 1]]
            again = K.word_hashes(words.data[begin[0] : end[-1]], begin - begin[0], end - begin[0], seeds[1])
            other = K.grams(again, window, seed=2)[starts]
            out.append((np.full(len(starts), names[i]), np.full(len(starts), lines[i]), starts.astype(np.int32), whole, other))
    if not out:
        return none
    name, line, start, one, two = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((start, line, name, two, one))
    o, t, place = one[order], two[order], np.stack([name, line, start])[:, order]
    head = np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])])
    # Against the first of its kind: the same position of a repeated row is no repeat of itself.
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = np.zeros(len(order), bool)
    later[order] = (place != place[:, first]).any(0)
    return name, line, start, one, two, later


def _lined(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, text, line): null ids become NO_ID and their rows, written once, get a number each; other rows have line 0."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    lost = written(rows.filter("id is null").select(F.lit(NO_ID).alias("id"), "text", F.monotonically_increasing_id().alias("line")), "lost")
    return rows.filter("id is not null").select("id", "text", F.lit(0).cast("long").alias("line")).unionByName(lost)


def _digest(value: str) -> int:
    """The line of a text whose id is listed with other texts too."""
    return int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], "big", signed=True)


def repeated_windows(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(id, lost, starts): of rows (id, text, line), runs (line, start, stop) of window positions whose words also start
    earlier (smaller id, then line, or same document). lost is the line of a row without an id, else 0. Rows that repeat
    an id and a text count as one document, position by position; other texts of that id are documents of their own,
    with their digests as lines."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    deal = F.when(F.col("id") == NO_ID, F.xxhash64("line")).otherwise(F.xxhash64("id", F.length("text")))
    rows = docs.withColumn("shard", F.pmod(deal, F.lit(1 + size // SHARD_BYTES)).cast("int"))
    none = F.lit(None).cast("long")
    seeds = K.draw_seed(), K.draw_seed()
    no_hash = none.alias("hash")
    anchors = recurring_anchors(rows, phrase, window, seeds[0]).select("shard", "hash", none.alias("copy"), none.alias("copy_line"), none.alias("clash"))
    named = rows.select("id", "line", "shard", F.unhex(F.sha2("text", 256)).alias("name")).filter("name is not null")
    # Ids that are listed with several texts.
    several = named.filter(F.col("id") != NO_ID).groupBy("id").agg(F.min("name").alias("least"), F.max("name").alias("most")).filter("least <> most").select("id", F.lit(True).alias("several"))
    named = named.join(several, "id", "left")
    line = F.when(F.col("several"), F.conv(F.hex(F.substring("name", 1, 8)), 16, -10).cast("long")).otherwise(F.col("line"))
    named = written(named.withColumn("line", line), "names")
    clashes = named.filter("several").select("shard", no_hash, none.alias("copy"), none.alias("copy_line"), F.col("id").alias("clash")).distinct()
    # Later copies of whole texts repeat in all their windows; only their ids and lines need to be known.
    earliest = named.groupBy("name").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = unique_join(named, earliest, "name").filter(F.struct("id", "line") != F.col("first")).select("shard", no_hash, F.col("id").alias("copy"), F.col("line").alias("copy_line"), none.alias("clash"))

    def shard(left: pa.Table, right: pa.Table) -> pa.Table:
        name, line, start, one, two, stop = _shard_windows(left, right, window, phrase, seeds)
        return pa.table([pa.array(name, pa.int64()), pa.array(line, pa.int64()), pa.array(start, pa.int32()), pa.array(K.signed(one)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(stop, pa.int32())], ["id", "line", "start", "one", "two", "stop"])

    found = rows.groupBy("shard").cogroup(anchors.unionByName(copies).unionByName(clashes).groupBy("shard")).applyInArrow(shard, "id long, line long, start int, one long, two int, stop int")
    # rank, not row_number: the same position of a repeated row is no repeat of itself.
    place = F.rank().over(W.partitionBy("one", "two").orderBy("id", "line", "start"))
    repeats = found.withColumn("place", place).filter("stop > start or place > 1")
    lost = F.when(F.col("id") == NO_ID, F.col("line")).otherwise(F.lit(0)).alias("lost")
    return repeats.groupBy("id", lost).agg(F.collect_set(F.struct("line", "start", F.greatest("stop", F.col("start") + 1).alias("stop"))).alias("starts"))


def _shard_windows(left: pa.Table, right: pa.Table, window: int, phrase: int, seeds: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Windows to compare with other shards (stop = 0), and runs start .. stop of windows known to be repeats."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.uint64, np.uint64, bool))
    ids, lines = left.column("id").to_numpy(), left.column("line").to_numpy().copy()
    for i in np.flatnonzero(np.isin(ids, right.column("clash").drop_null().to_numpy())).tolist():
        lines[i] = _digest(left.column("text")[i].as_py() or "")
    left = left.set_column(left.column_names.index("line"), "line", pa.array(lines))
    copies = set(zip(right.column("copy").drop_null().to_pylist(), right.column("copy_line").drop_null().to_pylist(), strict=True))
    known = np.fromiter((v in copies for v in zip(ids.tolist(), lines.tolist(), strict=True)), bool, len(ids))
    fresh = left.filter(pa.array(~known))
    recurring = np.unique(right.column("hash").drop_null().to_numpy().view(np.uint64))
    name, line, start, one, two, later = _candidates(fresh, recurring, window, phrase, seeds) if fresh.num_rows and len(recurring) else none
    stop = np.zeros(len(name), np.int64)
    if later.any():
        # Neighbouring repeats of one document become one run.
        n, d, s = name[later], line[later], start[later].astype(np.int64)
        order = np.lexsort((s, d, n))
        n, d, s = n[order], d[order], s[order]
        head = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)]))
        runs = n[head], d[head], s[head], s[np.append(head[1:], len(n)) - 1] + 1
        name, line, start, stop = (np.concatenate([a[~later], b]) for a, b in zip((name, line, start, stop), runs, strict=True))
        one, two = (np.concatenate([a[~later], np.zeros(len(head), np.uint64)]) for a in (one, two))
    whole = left.filter(pa.array(known))
    if whole.num_rows:
        column = whole.column("text").combine_chunks()
        count = np.diff(K.words_of(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, K.NOT_SPACE, hashes=False).first) - window + 1
        own, mine = (whole.column(c).to_numpy()[count > 0] for c in ("id", "line"))
        name, line, start, stop = (np.concatenate(x) for x in ((name, own), (line, mine), (start, np.zeros(len(own), np.int64)), (stop, count[count > 0])))
        one, two = (np.concatenate([a, np.zeros(len(own), np.uint64)]) for a in (one, two))
    runs = stop > 0
    # A run needs no partner: it goes to a group of its own.
    one = np.where(runs, K.mix((name.view(np.uint64) * np.uint64(31) + line.view(np.uint64)) * np.uint64(31) + start.astype(np.uint64)), one)
    two = np.where(runs, K.mix(one ^ np.uint64(0x5851F42D4C957F2D)), two)
    return name, line, start.astype(np.int64), one, two, stop


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by a blank) of every row.

    Words are runs of bytes outside blank, tab and line ends, unchanged. Null and empty texts have no words. Every row
    without an id is a document of its own, and so is every text of an id; rows that repeat both are one document.
    """
    rows = _lined(docs, text, key)
    starts = written(repeated_windows(rows, window, phrase), "repeats")
    rows = rows.withColumnRenamed("line", "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                out = []
                for name, value, at in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("starts"), strict=True):
                    words = (value or "").encode().split()
                    kept = words
                    if at.is_valid:
                        change = np.zeros(len(words) + 1, np.int64)
                        first, stop, line = (at.values.field(f).to_numpy() for f in ("start", "stop", "line"))
                        if name != NO_ID and line.any():
                            mine = line == _digest(value or "")
                            first, stop = first[mine], stop[mine]
                        np.add.at(change, first, 1)
                        np.add.at(change, stop + window - 1, -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                    out.append((None if name == NO_ID else name, len(words), len(words) - len(kept), b" ".join(kept).decode()))
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_text"])

    # A bitmap of fixed size over hashed ids: texts that surely keep all words need not be shuffled.
    bit = F.pmod(F.xxhash64("id", "lost"), F.lit(BITMAP))
    bitmap = starts.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    rows = rows.withColumns({"part": F.bitmap_bucket_number(bit + 1), "at": F.bitmap_bit_position(bit + 1)}).join(F.broadcast(bitmap), "part", "left")
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.select("id", "lost", "text", (F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")), F.lit(0)) > 0).alias("some"))
    clean = rows.filter("not some").select("id", "text", F.lit(None).cast("array<struct<line:long,start:int,stop:int>>").alias("starts"))
    touched = rows.filter("some").join(starts, ["id", "lost"], "left").select("id", "text", "starts")
    return clean.unionByName(touched).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM x) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
k AS (SELECT t.doc_id, t.p, t.word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) t ANTI JOIN c USING (doc_id, p)),
j AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(j.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""
