"""Near-duplicate detection by MinHash bands and odd sketches.

Each document's distinct word shingles give BANDS x ROWS MinHash samples. The samples, numbered, are also folded
into a parity bitmap (an odd sketch): two documents' bitmaps differ in about as many bits as their samples
differ, so a XOR and a population count tell high similarities precisely before any shingle is fetched. Documents
with equal shingle sets are one class from the start. In each band bucket all members are compared with one
pivot (another pivot order in every band), candidates that pass the sketch are confirmed on full shingle sets, and
links join components. Only buckets that still hold several components go on: there the members of the smaller
components meet all others block by block, pass a finer odd sketch and are confirmed inside the task, nearest
sketch first; a task joins components as it goes, leaves out pairs that are joined already, and gives back the links
that joined two, at most one for each component. So no link between components is lost, and neither groups of
copies nor dense groups of near copies ever expand into pairs that are sent on.
A pair at the threshold meets in no band with probability (1 - s**ROWS)**BANDS, 8e-7 at s = 0.85.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import kernels as K
from orrery.llm.storage import written
from orrery.plans.skew import hot_keys, unique_join

SHINGLE, SIMILARITY = 5, 80
BANDS, ROWS, BITS = 24, 5, 512
#: How many standard deviations below the threshold a sketch's estimate may lie for the pair to be confirmed.
SIGMAS = 5.5
_MULTIPLIERS = np.random.default_rng(77).integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_NUMBERS = np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Bins of the finer sample (the least shingle of each) and its bitmap's bits.
BINS, FINE = 1024, 2048
#: Members of a bucket in one block, and shingles in one block; pivot sets are repeated for so many pairs.
BLOCK, BLOCK_SHINGLES, PIVOT_PAIRS = 512, 1 << 21, 256
_SIGNATURE = "doc_id long, class binary, n_shingles long, bands array<long>, sketch array<long>"


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingle hashes, sorted; all words as one shingle if there are fewer than k."""
    if not len(words):
        return words
    return np.unique(K.grams(words, min(k, len(words)), seed=min(k, len(words))))


def samples(found: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hash functions over the shingles."""
    found = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_MULTIPLIERS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 512):
        np.minimum(out, (found[at : at + 512, None] * _MULTIPLIERS).min(0), out=out)
    return out.astype(np.uint64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """BITS parities, as 64-bit words, of the set of numbered samples."""
    bit = K.mix(sample ^ _NUMBERS) % np.uint64(BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_sketch(found: np.ndarray) -> bytes:
    """An odd sketch of the least shingle in each of BINS ranges: nearly the whole set, if the set is small."""
    slot = (found >> np.uint64(54)).astype(np.int64)
    least = found[np.concatenate([[True], slot[1:] != slot[:-1]])]
    odd = np.bincount((K.mix(least) % np.uint64(FINE)).astype(np.int64), minlength=FINE) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def most_fine_bits(size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Bits in which the fine sketches of two sets of these sizes may differ if they are that similar.

    That many shingles differ at most; each that shared its bin may bring another to light, and in full bins
    it is the share of bins that differ (both with SIGMAS deviations). Bits differ no more than items do, and
    fewer where items meet in a bit."""
    total = size_a + size_b
    apart = (1 - similarity) / (1 + similarity) * total
    shared = apart * np.clip(1 - BINS / (total / 2) * (1 - np.exp(-total / 2 / BINS)), 0, 1)
    full = 2 * BINS * (1 - similarity) + 2 * SIGMAS * np.sqrt(BINS * similarity * (1 - similarity))
    items = np.minimum(apart + shared + SIGMAS * np.sqrt(shared), full)
    bits = FINE / 2 * (1 - (1 - 2 / FINE) ** items)
    return np.minimum(items, bits + SIGMAS * np.sqrt(np.maximum(items - bits, 0)))


def most_bits(similarity: float) -> int:
    """Bits in which two sketches may differ for their documents to be possibly that similar."""
    n = BANDS * ROWS
    low = max(0.0, similarity - SIGMAS * np.sqrt(similarity * (1 - similarity) / n))
    expected = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * n * (1 - low)))
    return int(np.ceil(expected + 3 * np.sqrt(BITS) / 4))


def class_of(found: np.ndarray) -> bytes:
    """A name of the shingle set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int, text: str, key: str, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                words = K.words_of(part.column("text"), K.NOT_SPACE, lower=True, seed=seed)
                rows = []
                for _, own in K.per_doc(words):
                    found = shingles(own, k)
                    if not len(found):
                        rows.append((b"", 0, [], []))
                        continue
                    sample = samples(found)
                    with np.errstate(over="ignore"):
                        mixed = K.mix(sample).reshape(BANDS, ROWS) * (np.arange(ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(3))
                        band = K.mix(mixed.sum(1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
                    rows.append((class_of(found), len(found), K.signed(band).tolist(), odd_sketch(sample).tolist()))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                types = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "class", "n_shingles", "bands", "sketch"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(K.tidy(run), _SIGNATURE)


def _sets(docs: DataFrame, wanted: DataFrame, k: int, text: str, key: str, seed: int) -> DataFrame:
    """(v, shingles) of the classes in wanted (v, class, least), read from the rows of their least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                words = K.words_of(part.column("text"), K.NOT_SPACE, lower=True, seed=seed)
                found = {class_of(own): own for own in (shingles(own, k) for _, own in K.per_doc(words)) if len(own)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([K.signed(x) for x in found.values()], pa.list_(pa.int64()))], ["class", "shingles"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("least"), F.col(f"`{text}`").alias("text"))
    found = rows.join(wanted.select("least").distinct(), "least", "left_semi").mapInArrow(K.tidy(run), "class binary, shingles array<long>")
    return found.dropDuplicates(["class"]).join(wanted.select("class", "v"), "class").select("v", "shingles")


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(v, component): the least node that each node reaches over edges (a, b). Without nodes: the ends of the edges.

    Every round takes the least label among neighbours and then the label's own label; it ends when none changes. Nodes
    without edges have no part in the rounds. Edges stay as they are, so their hot ends are counted once.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.select(F.col("a").alias("v")).distinct().withColumn("component", F.col("v")), "labels")
    ends, total = hot_keys(both, "b"), labels.count()
    while total:
        near = unique_join(both, labels.withColumnRenamed("v", "b"), "b", known=ends).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        least = written(least, "least")
        jump = least.select(F.col("v").alias("component"), F.col("component").alias("further"))
        heads = hot_keys(least, "component", total)
        after = written(unique_join(least, jump, "component", known=heads).select("v", "old", F.col("further").alias("component")), "labels")
        labels = after.select("v", "component")
        if after.filter("old <> component").isEmpty():
            break
    if nodes is None:
        return labels
    return written(nodes.select("v").join(labels, "v", "left").select("v", F.coalesce("component", "v").alias("component")), "labels")


def _pivots(buckets: DataFrame, similarity: int) -> DataFrame:
    """(v, pivot, n): members and pivots of buckets whose sketches and set sizes allow the similarity; n: largest bucket."""
    differ = F.aggregate(F.zip_with("sketch", "pivot_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = 100 * F.least("n_shingles", "pivot_size") >= similarity * F.greatest("n_shingles", "pivot_size")
    near = buckets.filter("v <> pivot").filter(fits & (differ <= most_bits(similarity / 100)))
    return near.groupBy("v", "pivot").agg(F.max("n").alias("n"))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of member and pivot that are linked, on their full shingle sets.

    A pivot's set comes once for every PIVOT_PAIRS members of its largest bucket, which are dealt over these copies."""
    copies = F.floor(F.col("n") / PIVOT_PAIRS).cast("int")
    dealt = pairs.withColumn("copy", F.pmod(F.xxhash64("v"), copies + 1).cast("int"))
    pivots = pairs.groupBy(F.col("pivot").alias("v")).agg(F.max(copies).alias("copies")).join(sets, "v")
    pivots = pivots.select(F.col("v").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("copies"))).alias("copy"), F.col("shingles").alias("sb"))
    held = dealt.drop("n").join(sets.select("v", F.col("shingles").alias("sa")), "v").join(pivots, ["pivot", "copy"])
    common = F.size(F.array_intersect("sa", "sb"))
    held = held.select(F.col("v").alias("a"), F.col("pivot").alias("b"), (F.size("sa") + F.size("sb")).alias("total"), common.alias("common"))
    return held.filter(100 * F.col("common") >= similarity * (F.col("total") - F.col("common"))).select("a", "b")


def _members(table: pa.Table) -> dict:
    """Columns of the rows of one side of a task, with their sets in a row and their fine sketches."""
    sets = table.column("shingles").combine_chunks()
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    ends = sets.offsets.to_numpy().astype(np.int64)
    flat = sets.values.to_numpy().view(np.uint64)
    fine = b"".join(fine_sketch(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False))
    return {
        "v": table.column("v").to_numpy(),
        "component": table.column("component").to_numpy(),
        "minor": table.column("minor").to_numpy(),
        "bands": np.array(table.column("bands").to_pylist(), np.int64).reshape(table.num_rows, BANDS),
        "begin": ends[:-1],
        "size": np.diff(ends),
        "flat": flat,
        "fine": np.frombuffer(fine, np.uint64).reshape(table.num_rows, -1),
    }


def task_links(few: pa.Table, many: pa.Table, similarity: int) -> list[tuple[int, int]]:
    """Links between members of few and of many that join components which no link of this task has joined before."""
    x, y = _members(few), _members(many)
    band = few.column("band")[0].as_py()
    names, code = np.unique(np.concatenate([x["component"], y["component"]]), return_inverse=True)
    code_x, code_y = code[: len(x["v"])], code[len(x["v"]) :]
    group = np.arange(len(names))
    out = []
    for i in range(len(x["v"])):
        size = x["size"][i]
        ok = (group[code_y] != group[code_x[i]]) & (100 * np.minimum(y["size"], size) >= similarity * np.maximum(y["size"], size))
        # A pair is taken up in the first band that it shares, and once if both are minor.
        at = np.flatnonzero(ok & ~(y["minor"] & (y["v"] < x["v"][i])))
        at = at[(y["bands"][at, :band] != x["bands"][i, :band]).all(1)]
        differ = np.bitwise_count(y["fine"][at] ^ x["fine"][i]).sum(1)
        fits = differ <= most_fine_bits(y["size"][at], size, similarity / 100)
        at = at[fits][np.argsort(differ[fits], kind="stable")]
        own = x["flat"][x["begin"][i] : x["begin"][i] + size]
        step = 8
        while len(at):
            now, at = at[:step], at[step:]
            held = y["flat"][K.ragged(y["begin"][now], y["size"][now])]
            same = own[np.minimum(np.searchsorted(own, held), size - 1)] == held
            common = np.add.reduceat(same.astype(np.int64), np.cumsum(y["size"][now]) - y["size"][now])
            for j in now[100 * common >= similarity * (size + y["size"][now] - common)].tolist():
                mine, other = group[code_x[i]], group[code_y[j]]
                if mine != other:
                    out.append((int(x["v"][i]), int(y["v"][j])))
                    group[group == other] = mine
            at = at[group[code_y[at]] != group[code_x[i]]]
            step *= 4
    return out


def _across(live: DataFrame, heads: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between members of different components in one bucket; see task_links.

    live: (band, bucket, v, component, major, n_shingles). Every task holds one block of the smaller components'
    members and one block of all members of a bucket."""
    minor = F.col("component") != F.col("major")
    count = lambda some: F.sum(F.when(some, 1).otherwise(0))
    weight = lambda some: F.sum(F.when(some, F.col("n_shingles")).otherwise(0))
    blocks = lambda some: (F.floor(F.greatest(count(some) / BLOCK, weight(some) / BLOCK_SHINGLES)) + 1).cast("int")
    size = live.groupBy("band", "bucket").agg(blocks(minor).alias("few"), blocks(F.lit(True)).alias("all"))
    rows = unique_join(live, size, ["band", "bucket"]).withColumn("minor", minor)
    dealt = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    as_many = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda b: F.struct(b.alias("block"), dealt("all").alias("other"), F.lit(False).alias("mine")))
    as_few = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda b: F.struct(dealt("few").alias("block"), b.alias("other"), F.lit(True).alias("mine")))
    tasks = F.explode(F.when(F.col("minor"), F.concat(as_few, as_many)).otherwise(as_many))
    rows = rows.join(heads.select("v", "bands"), "v").join(sets, "v").select("band", "bucket", "v", "component", "minor", "bands", "shingles", tasks.alias("t"))
    rows = rows.select("band", "bucket", "t.block", "t.other", "t.mine", "v", "component", "minor", "bands", "shingles")

    def links(table: pa.Table) -> pa.Table:
        mine = table.column("mine")
        few, many = table.filter(mine), table.filter(pc.invert(mine))
        found = task_links(few, many, similarity) if few.num_rows and many.num_rows else []
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return rows.groupBy("band", "bucket", "block", "other").applyInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked if 100 * common >= similarity * union of their distinct k-word shingles (whole words,
    A-Z lower-cased); component_id is the least doc_id reachable; kept is doc_id = component_id. Documents without
    words are linked with nothing. A null doc_id is never compared and stays alone (component_id null, kept);
    rows that repeat a doc_id are documents of their own, and links of each count. An empty table gives none.
    """
    seed = K.draw_seed()
    signed = written(signatures(docs, k, text, key, seed), "signatures")
    solid = signed.filter("n_shingles > 0 and doc_id is not null")
    heads = solid.groupBy("class").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # Numbers that are fixed once written; every class is a vertex.
    heads = written(heads.withColumn("v", F.monotonically_increasing_id()), "heads")
    member = heads.select("v", "sketch", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    pivot = member.groupBy("band", "bucket").agg(F.min_by("v", F.xxhash64("band", "v")).alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    pivot = written(pivot, "pivots")
    bare = member.select("band", "bucket", "v")
    buckets = written(_bucket_join(bare, pivot, heads.count()), "buckets")
    facts = heads.select("v", "sketch", "n_shingles")
    of_pivot = heads.select(F.col("v").alias("pivot"), F.col("sketch").alias("pivot_sketch"), F.col("n_shingles").alias("pivot_size"))
    met = written(buckets.filter("v <> pivot").groupBy("v", "pivot").agg(F.max("n").alias("n")), "met")
    near = unique_join(met, of_pivot, "pivot").join(facts, "v")
    near = written(_pivots(near, similarity), "near")
    wanted = near.select("v").unionByName(near.select(F.col("pivot").alias("v"))).unionByName(buckets.filter("n > 2").select("v")).distinct()
    sets = written(_sets(docs, heads.select("v", "class", "least").join(wanted, "v", "left_semi"), k, text, key, seed), "sets")
    links = written(_confirmed(near, sets, similarity), "links")
    labels = connected(links, heads.select("v"))
    # What is left: buckets of three and more with several components. Their largest component is the other side.
    labelled = written(buckets.filter("n > 2").join(labels, "v").join(heads.select("v", "n_shingles"), "v").select("band", "bucket", "v", "component", "n_shingles"), "labelled")
    spread = labelled.groupBy("band", "bucket", "component").agg(F.count("*").alias("n"))
    open_ = spread.groupBy("band", "bucket").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("parts")).filter("parts > 1")
    live = written(unique_join(labelled, open_.drop("parts"), ["band", "bucket"]), "open")
    more = written(_across(live, heads, sets, similarity), "links")
    if not more.isEmpty():
        of = lambda side: labels.select(F.col("v").alias(side), F.col("component").alias(f"{side}_"))
        arcs = written(more.join(of("a"), "a").join(of("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b")).filter("a <> b").distinct(), "arcs")
        joined = connected(arcs)
        joined = joined.select(F.col("v").alias("component"), F.col("component").alias("further"))
        labels = written(unique_join(labels, joined, "component", "left").select("v", F.coalesce("further", "component").alias("component")), "labels")
    named = written(heads.select("v", "class", "least").join(labels, "v"), "named")
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    group = unique_join(named, first, "component").select("class", "component_id")
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("class")).alias("class"))
    out = unique_join(rows, group, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _bucket_join(member: DataFrame, pivot: DataFrame, vertices: int) -> DataFrame:
    """member with pivot and n of its bucket, if it has company. Buckets of over a thousandth of all vertices, at most a
    thousand in each band, are broadcast, so their members stay where they are."""
    hot = F.broadcast(pivot.filter(F.col("n") * 1000 > vertices))
    rest = pivot.filter(F.col("n") * 1000 <= vertices)
    keys = ["band", "bucket"]
    return member.join(hot, keys).unionByName(member.join(F.broadcast(pivot.filter(F.col("n") * 1000 > vertices).select(*keys)), keys, "left_anti").join(rest, keys)).select("band", "bucket", "v", "pivot", "n")


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, k=3, similarity=85)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
