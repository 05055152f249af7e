"""Repeated passages by a sparse suffix array.

Only suffixes that begin at anchors (least phrase hash of every MIN_WORDS words, so every long enough passage holds
one) are kept, and of these only the ones whose anchor phrase recurs. They are sorted across the cluster by anchor,
words that follow and words that precede: a range partitioning in which even one anchor that fills a third of
the table is spread over many tasks. Neighbours are compared and their match extended to the right and to the left;
each partition's first and last suffix are compared once more across the border. A second sort puts the words that
precede first. So each suffix knows its longest match to the right, its longest to the left, and which windows its
neighbours share. Only windows within the longest matches that no neighbour shares may have a partner elsewhere; these
are compared as wholes with those of their anchor that may be equal, one for each run of neighbours that share a window,
so no passage is missed.
Matches of at least MIN_WORDS words are merged into passages by document. Copies of whole texts are known by
digest; one of each group has suffixes and stands for the others.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm import kernels as K
from orrery.llm.recurring import NO_ID, recurring_anchors, sharded, told_apart
from orrery.llm.storage import written
from orrery.plans.skew import unique_join

MIN_WORDS, PHRASE = 50, 8
_SUFFIX = "hash long, after binary, before binary, id long, line long, position int, partner long"
_FIELDS = ["hash", "after", "before", "id", "line", "position"]
#: Each suffix's neighbours: in the order by words after or before, the one in front (back) or behind (on); the words that
#: are equal to the left of the anchor and from it on, and the neighbour's document.
_AFTER, _BEFORE = ["after_back", "after_on"], ["before_back", "before_on"]
_MET = {"left": "int", "right": "int", "with": "long"}
#: Bytes of a word's keyed hash in a suffix.
WORD = 6
#: Suffixes of one text or one anchor share most words, farther apart than Parquet's usual codec looks.
PACKED = {"compression": "zstd"}
#: Bytes of texts that a task takes apart at once.
SLICE_BYTES = 1 << 20
#: Windows of an anchor are matched in so many spans of their offsets.
SPANS = 8


def _copies(rows: DataFrame) -> DataFrame:
    """(shard, name, first, home, last) of texts that are listed more than once, by digest: the least and the greatest id,
    and a shard that has the least."""
    named = written(rows.filter("text is not null").select("id", "shard", F.unhex(F.sha2("text", 256)).alias("name")), "names")
    groups = named.groupBy("name").agg(F.min(F.struct("id", "shard")).alias("least"), F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    groups = groups.select("name", F.col("least.id").alias("first"), F.col("least.shard").alias("home"), "last")
    return unique_join(named.select("shard", "name").distinct(), groups, "name")


def _suffixes(rows: DataFrame, anchors: DataFrame, min_words: int, phrase: int, seed: int) -> DataFrame:
    """Suffixes at recurring anchors: words after (and at) and before each, as WORD-byte hashes; before is reversed.
    A text's edge is random words.

    Of equal texts only one under the least id has suffixes. All of them, if long enough, give a row without a hash
    that holds their number of words and another text's id. line is a digest of the text, so that different texts of one
    id, or without an id, are told apart."""
    reach = min_words - phrase

    def shard(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return cut(left, right)
        finally:
            K.give_back()

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        recurring = np.sort(right.column("hash").drop_null().to_numpy().view(np.uint64))
        copies = right.filter(right.column("name").is_valid())
        copies = dict(zip(copies.column("name").to_pylist(), zip(*(copies.column(c).to_pylist() for c in ("first", "home", "last")), strict=True), strict=True))
        out: list[tuple] = []
        begun = set()
        if (len(recurring) or copies) and left.num_rows:
            here = left.column("shard")[0].as_py()
            for part in K.slices(left.combine_chunks().to_batches()[0], limit=SLICE_BYTES):
                names, text = part.column("id").to_numpy(), part.column("text")
                words = K.words_of(text, K.NOT_SPACE, seed=seed)
                for i, own in K.per_doc(words):
                    if len(own) < min_words:
                        continue
                    digest = hashlib.sha256(text[i].as_py().encode()).digest()
                    line = int.from_bytes(digest[:8], "big", signed=True)
                    same = copies.get(digest) if copies else None
                    if same:
                        out.append((None, None, None, int(names[i]), line, len(own), same[2] if names[i] == same[0] else same[0]))
                        if (names[i], here) != same[:2] or digest in begun:
                            continue
                        begun.add(digest)
                    if not len(recurring):
                        continue
                    hashes = K.grams(own, phrase)
                    _, at = K.minimisers(hashes, min_words - phrase + 1)
                    at = at[recurring[np.minimum(np.searchsorted(recurring, hashes[at]), len(recurring) - 1)] == hashes[at]]
                    short = own.astype(">u8")
                    # Drawn anew, so that no two rows have the same edge.
                    edge = np.random.default_rng(secrets.randbits(64)).integers(0, 2**63, reach + min_words, dtype=np.uint64)
                    padded = np.concatenate([edge[:reach].astype(">u8"), short, edge[reach : reach + min_words].astype(">u8")])
                    padded = padded.view(np.uint8).reshape(-1, 8)[:, :WORD]
                    for p in at.tolist():
                        q = p + reach
                        out.append((int(hashes[p].view(np.int64)), padded[q : q + min_words].tobytes(), padded[q - reach : q][::-1].tobytes(), int(names[i]), line, p, None))
        columns = list(zip(*out, strict=True)) or [()] * 7
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*_FIELDS, "partner"])

    none = F.lit(None)
    told = anchors.select("shard", "hash", none.cast("binary").alias("name"), none.cast("long").alias("first"), none.cast("int").alias("home"), none.cast("long").alias("last"))
    told = told.unionByName(_copies(rows).select("shard", none.cast("long").alias("hash"), "name", "first", "home", "last"))
    return rows.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(shard, _SUFFIX)


def _table(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), ">u2").reshape(batch.num_rows, width, WORD // 2)


def _common(a: np.ndarray) -> np.ndarray:
    """Equal leading words of each row and the next."""
    same = (a[1:] == a[:-1]).all(2)
    return np.where(same.all(1), a.shape[1], same.argmin(1))


def _compare(batches: Iterator[pa.RecordBatch], sides: list[str], min_words: int, phrase: int) -> Iterator[pa.RecordBatch]:
    """Rows in the given order, each told what it has in common with the one in front and the one behind it, if they have
    its anchor and where that is not known yet. The first and the last row are edges."""
    reach = min_words - phrase
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = np.zeros(batch.num_rows, bool)
        edge[0] = last is None
        batch = batch.set_column(batch.schema.get_field_index("edge"), "edge", pa.array(edge))
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        right, left = _common(_table(batch, "after", min_words)), _common(_table(batch, "before", reach))
        key, name = batch.column("hash").to_numpy(), batch.column("id").to_numpy()
        hit = np.flatnonzero(key[1:] == key[:-1])
        for side, mine, other in zip(sides, (hit + 1, hit), (hit, hit + 1), strict=True):
            blank = np.ones(batch.num_rows, bool)
            blank[mine] = False
            for what, values in (("left", left[hit].astype(np.int32)), ("right", right[hit].astype(np.int32)), ("with", name[other])):
                at = batch.schema.get_field_index(f"{side}_{what}")
                told = np.zeros(batch.num_rows, values.dtype)
                told[mine] = values
                batch = batch.set_column(at, f"{side}_{what}", pc.coalesce(batch.column(at), pa.array(told, mask=blank)))
        yield batch.slice(0, batch.num_rows - 1)
        last = batch.slice(batch.num_rows - 1)
    if last is not None:
        yield last.set_column(last.schema.get_field_index("edge"), "edge", pa.array([True]))


def _neighbours(rows: DataFrame, order: list[str], sides: list[str], min_words: int, phrase: int, needed: Column | None = None) -> DataFrame:
    """The suffixes with what they have in common with their neighbours in that order. Where they are not needed any
    more, their words are left out."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = K.tidy(lambda batches: _compare(batches, sides, min_words, phrase))
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = laid.select("*", *(F.lit(None).cast(t).alias(f"{side}_{what}") for side in sides for what, t in _MET.items()), F.lit(False).alias("edge"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in laid.schema.fields)
    met = laid.mapInArrow(run, schema)
    if needed is not None:
        met = met.withColumns({c: F.when(F.col("edge") | needed, F.col(c)) for c in ("after", "before")})
    inner = written(met, "neighbours", PACKED)
    # Two rows a partition: the borders between partitions, compared in one small task.
    edges = inner.filter("edge").repartition(1).sortWithinPartitions(*order)
    return inner.filter("not edge").unionByName(edges.mapInArrow(run, schema)).drop("edge")


def _bits(low: Column, high: Column) -> Column:
    """A number with the bits from low to high: windows by the words before their anchor. None if there is a null."""
    n = high - low + 1
    return F.when(n > 0, F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - n), low)).otherwise(F.lit(0).cast("long"))


def _windows(min_words: int, phrase: int) -> tuple[Column, Column]:
    """(able, open): windows of a suffix that stand for all equal ones of a run of neighbours, and those of them that no
    neighbour shares."""
    of = lambda side: _bits(min_words - F.col(f"{side}_right"), F.col(f"{side}_left"))
    most = lambda sides, what: F.greatest(*(f"{side}_{what}" for side in sides))
    # A window that begins o words before the anchor has a partner only if some match is so long to the left and some to the right.
    may = _bits(min_words - most(_AFTER, "right"), most(_BEFORE, "left"))
    # What the row in front shares, that row or one before it stands for: by one order for each o, so no two stand for each other.
    few = (1 << (min_words - phrase) // 2) - 1
    front = of(_AFTER[0]).bitwiseAND(F.lit(few)).bitwiseOR(of(_BEFORE[0]).bitwiseAND(F.lit(~few)))
    shared = of(_AFTER[0]).bitwiseOR(of(_AFTER[1])).bitwiseOR(of(_BEFORE[0])).bitwiseOR(of(_BEFORE[1]))
    return may.bitwiseAND(F.bitwise_not(front)), may.bitwiseAND(F.bitwise_not(shared))


def _whole_windows(met: DataFrame, min_words: int, phrase: int, seed: int) -> DataFrame:
    """(id, line, start): windows that no neighbour shares and that occur at least twice, compared as wholes by 128 bits
    with the windows of their anchor that may be equal."""
    reach = min_words - phrase
    able, open_ = _windows(min_words, phrase)
    held = met.select(*_FIELDS, able.alias("able"), open_.alias("open")).filter("able != 0")
    gaps = held.filter("open != 0")
    anchors = written(gaps.groupBy("hash").agg(F.bit_or("open").alias("offsets")), "gaps")
    # Windows of few offsets share most of their words: those that all of them hold tell which can be equal at all.
    ends = np.linspace(0, reach + 1, SPANS + 1).astype(int).tolist()
    spans = []
    for lo, hi in zip(ends, ends[1:], strict=False):
        if lo < hi:
            common = F.xxhash64("hash", F.lit(lo), F.substring("after", 1, (min_words - hi + 1) * WORD), F.substring("before", 1, lo * WORD))
            mask = F.lit((1 << hi) - (1 << lo))
            spans.append(F.struct(common.alias("common"), F.col("able").bitwiseAND(mask).alias("able"), F.col("open").bitwiseAND(mask).alias("open")))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.select(*_FIELDS, F.explode(F.array(*spans)).alias("span")).select(*_FIELDS, "span.*").filter("able != 0")

    offsets = written(dealt(gaps).filter("open != 0").groupBy("common").agg(F.bit_or("open").alias("offsets")), "gaps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            before = _wide(_table(batch, "before", reach))[:, ::-1]
            words = np.concatenate([before, _wide(_table(batch, "after", min_words))], 1)
            offsets, unmet = batch.column("offsets").to_numpy(), batch.column("open").to_numpy()
            key = batch.column("hash").to_numpy().view(np.uint64)
            found = []
            for o in range(reach + 1):
                at = np.flatnonzero((offsets >> o) & 1)
                window = words[at, reach - o : reach - o + min_words]
                one, two = (K.mix(K.window_hash(window, seed + n) ^ K.mix(key[at] + np.uint64(o))) for n in (0, 1))
                found.append((at, np.full(len(at), o), one, two))
            at, offset, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
            _, code = np.unique(one ^ K.mix(two), return_inverse=True)
            index, own, salt, n = told_apart(code, np.arange(len(at)))
            # Rows that only count for others have no document: of windows that recur here, one does.
            real = (own >= 0) & ((unmet[at[index]] >> offset[index]) & 1 > 0)
            kept = real | (salt == 0)
            index, real, salt, n = index[kept], real[kept], salt[kept], n[kept]
            name, line = (batch.column(c).take(pa.array(at[index])) for c in ("id", "line"))
            start = batch.column("position").to_numpy()[at[index]] - offset[index]
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(one[index])), pa.array(K.signed(two[index])), name, line, pa.array(start.astype(np.int32)), pa.array(real), pa.array(np.where(salt > 0, np.arange(len(salt)) + 1, 0).astype(np.int32)), pa.array(n)], ["one", "two", "id", "line", "start", "real", "salt", "n"])

    both = F.col("offsets").bitwiseAND(F.col("able"))
    near = unique_join(held, anchors, "hash").withColumn("able", both).filter("able != 0")
    rows = unique_join(written(dealt(near), "near", PACKED), offsets, "common").withColumn("offsets", both).filter("offsets != 0")
    rows = rows.mapInArrow(K.tidy(run), "one long, two long, id long, line long, start int, real boolean, salt int, n int")
    total = F.sum("n").over(W.partitionBy("one", "two", "salt"))
    return rows.withColumn("total", total).filter("total > 1 and real").select("id", "line", "start")


def _passages(met: DataFrame, min_words: int) -> DataFrame:
    """(id, line, start, stop, partners): a suffix's matches of at least min_words words as one, as all hold its anchor."""
    sides = [*_AFTER, *_BEFORE]
    long = {side: F.col(f"{side}_left") + F.col(f"{side}_right") >= min_words for side in sides}
    most = lambda what: F.greatest(*(F.when(long[side], F.col(f"{side}_{what}")) for side in sides))
    partners = F.array_compact(F.array(*(F.when(long[side], F.col(f"{side}_with")) for side in sides)))
    found = met.select("id", "line", (F.col("position") - most("left")).alias("start"), (F.col("position") + most("right")).alias("stop"), F.array_distinct(partners).alias("partners"))
    return found.filter("start is not null")


def _wide(table: np.ndarray) -> np.ndarray:
    """Words of a suffix as numbers."""
    t = table.astype(np.uint64)
    return (t[:, :, 0] << np.uint64(32)) | (t[:, :, 1] << np.uint64(16)) | t[:, :, 2]


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, phrase: int = PHRASE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, stop, partners): passages, as word positions, of at least min_words words that some other place
    has as well, with the documents they were matched with. Words are runs outside blanks, unchanged.

    Null and empty texts have none. Documents are told apart by id and text: different texts of one id, or without an id,
    are documents of their own; rows that repeat both are one document, listed twice, whose whole text is a passage with
    itself as a partner. A partner without an id is null.
    A passage that recurs within its own document names that document as its partner; partners are the neighbours in
    the two orders, at least one wherever a neighbour shares the passage. Words are compared by keyed hashes of 48 bits.
    Extra columns are left aside; an empty table gives no passage.
    """
    if min_words - phrase > 62:
        raise ValueError("offsets before an anchor must fit 63 bits: min_words - phrase <= 62")
    rows = sharded(docs, text, key)
    seed = K.draw_seed()
    every = written(_suffixes(rows, recurring_anchors(rows, phrase, min_words, seed, SLICE_BYTES), min_words, phrase, seed), "suffixes", PACKED)
    none = F.lit(None).cast("array<long>")
    copied = every.filter("hash is null").select("id", "line", F.lit(0).alias("start"), F.col("position").alias("stop"), F.array("partner").alias("partners")).distinct()
    suffixes = every.filter("hash is not null").select(*_FIELDS)
    by_after = _neighbours(suffixes, ["hash", "after", "before", "id", "line", "position"], _AFTER, min_words, phrase)
    met = _neighbours(by_after, ["hash", "before", "after", "id", "line", "position"], _BEFORE, min_words, phrase, _windows(min_words, phrase)[0] != 0)
    whole = _whole_windows(met, min_words, phrase, K.draw_seed() >> 1)
    found = _passages(met, min_words).unionByName(copied).unionByName(whole.select("id", "line", "start", (F.col("start") + min_words).alias("stop"), none.alias("partners")))
    # Passages that overlap or touch are one: a new one begins behind all that came before in its text.
    order = W.partitionBy("id", "line").orderBy("start", "stop")
    behind = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce((F.col("start") > behind).cast("int"), F.lit(1)))
    each = found.withColumn("passage", F.sum("new").over(order)).groupBy("id", "line", "passage").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("partners")))).alias("with"))
    partners = F.transform("with", lambda w: F.nullif(w, F.lit(NO_ID)))
    return each.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("start").cast("long"), F.col("stop").cast("long"), partners.alias("partners"))


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
