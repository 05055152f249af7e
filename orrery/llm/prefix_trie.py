"""The prefix trie of conversations, by radix partitioning from the first turn on.

Turns are coded by a dictionary of distinct (role, text); a conversation is its list of turn ids, and equal ones are one
sequence. A bucket holds the sequences that share a prefix. While a bucket is large, a round deals its sequences to new
buckets by the next turn id, across the cluster, and skips what they all share (the common prefix of the bucket's
least and greatest sequence), so rounds follow the branchings of large buckets and not the length of conversations. Buckets
of at most LOCAL sequences are finished where they are by multikey quicksort, whose recursion emits the nodes. What nodes
sum up over their subtrees is then added up through the large buckets, from the last round to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.storage import written
from orrery.plans.skew import unique_join
from orrery.sources.graphs import numbered

#: Sequences, and turns in them, of a bucket that one task finishes.
LOCAL, LOCAL_TURNS = 256, 1 << 20
#: The first turns of another conversation that a rebuilt one may take.
MOST_SHARED = 8
_NODE = "top boolean, bucket long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, seq long"
_TURNS = "array<struct<id:bigint,bytes:bigint>>"


def coded_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turns): each conversation's turns (id, bytes of text) in order, and (id, role, text) of the dictionary.

    Turns sort by number (null first), role and text; null roles and texts are empty. Rows without a conv_id belong to
    no conversation. A turn is known by the SHA-256 of its role and text."""
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # A list in order of the turns' numbers; only equal numbers have to be told apart by what was said.
    name = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")), 256))
    # A role that is cut off is no longer followed by its text.
    begin = F.when(F.length("role") < 64, F.substring("text", 1, 64)).otherwise("")
    rows = rows.withColumns({"name": name, "head": F.substring("role", 1, 64), "begin": begin})
    slim = written(rows.select("conv_id", "turn", "name", F.octet_length("text").cast("long").alias("bytes"), "head", "begin"), "turns")
    # Equal numbers whose roles and texts begin alike are put in order by the whole strings: only these are fetched.
    tied = ["conv_id", "turn", "head", "begin"]
    alike = slim.groupBy(*tied).agg(F.min("name").alias("least"), F.max("name").alias("most")).filter("least <> most").select(*tied)
    alike = written(alike, "alike")
    if alike.isEmpty():
        slim = slim.withColumn("place", F.lit(0).cast("long"))
    else:
        same = [rows[c].eqNullSafe(alike[c]) for c in tied]
        whole = rows.join(alike, same, "left_semi")
        texts = whole.select("name", "role", "text").dropDuplicates(["name"])
        # Ids in order of role and text.
        places = numbered(texts, ["role", "text"], "place").select("name", "place")
        slim = unique_join(slim, places, "name", "left").withColumn("place", F.coalesce("place", F.lit(0).cast("long")))
    names = written(slim.groupBy("name").agg(F.first("bytes").alias("bytes")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = unique_join(slim.drop("bytes"), names, "name").select("conv_id", F.struct("turn", "head", "begin", "place", "id", "bytes").alias("t"))
    listed = F.transform(F.array_sort(F.collect_list("t"), _before), lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes")))
    texts = rows.dropDuplicates(["name"]).join(names.select("name", "id"), "name").select("id", "role", "text")
    return written(coded.groupBy("conv_id").agg(listed.alias("turns")), "sequences"), texts


def _before(a: Column, b: Column) -> Column:
    """Order of two turns: null numbers first."""
    number = F.when(a["turn"].isNull() & b["turn"].isNull(), 0).when(a["turn"].isNull(), -1).when(b["turn"].isNull(), 1).when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0)
    x, y = F.struct(a["head"], a["begin"], a["place"]), F.struct(b["head"], b["begin"], b["place"])
    return F.when(number != 0, number).when(x < y, -1).when(x > y, 1).otherwise(0)


def trie_of(keys: list[list[int]], sizes: list[list[int]], first: list[int], n: list[int], seq: list[int], depth: int, parent: int) -> list[tuple]:
    """Nodes (top, first, depth, parent's first, n, children, leaves, saved, seq) below the shared prefix of `depth` turns, by
    multikey quicksort; parent is the least member of the prefix's node. Every sequence is longer than the prefix."""
    nodes: list[list] = []
    above: list[int] = []
    waiting = [(list(range(len(keys))), depth, -1)]
    while waiting:
        own, d, up = waiting.pop()
        pivot = keys[own[len(own) // 2]][d]
        less, more, same = [], [], []
        for i in own:
            letter = keys[i][d]
            (same if letter == pivot else less if letter < pivot else more).append(i)
        for side in (less, more):
            if side:
                waiting.append((side, d, up))
        # The equal part is a node; a sequence that is alone in it runs on to its end.
        while same:
            d += 1
            members, least = sum(n[i] for i in same), min(first[i] for i in same)
            ended = [i for i in same if len(keys[i]) == d]
            nodes.append([up < 0, least, d, parent if up < 0 else nodes[up][1], members, 0, 0, (members - 1) * sizes[same[0]][d - 1], seq[ended[0]] if ended else None])
            above.append(up)
            up = len(nodes) - 1
            if len(same) > 1:
                same = [i for i in same if len(keys[i]) > d]
                if same:
                    waiting.append((same, d, up))
                break
            if ended:
                break
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if not node[5]:
            node[6] = 1
        if above[k] >= 0:
            upper = nodes[above[k]]
            upper[5] += 1
            upper[6] += node[6]
            upper[7] += node[7]
    return [tuple(x) for x in nodes]


def _finished(rows: DataFrame) -> DataFrame:
    """The nodes of small buckets: rows (bucket, parent, depth, upper, seq, n, first, turns), upper is the large bucket
    above, parent its least member. Buckets go through a task one after the other."""

    def emit(bucket: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(bucket)
        turns = table.column("turns").to_pylist()
        keys, sizes = ([[t[f] for t in own] for own in turns] for f in ("id", "bytes"))
        upper, depth, parent = (table.column(c)[0].as_py() for c in ("upper", "depth", "parent"))
        found = trie_of(keys, sizes, *(table.column(c).to_pylist() for c in ("first", "n", "seq")), depth, parent)
        columns = list(zip(*found, strict=True))
        kinds = [pa.bool_(), *[pa.int64()] * 8]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        arrays.insert(1, pa.array([upper] * len(found), pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _NODE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        name = None
        for batch in batches:
            ids = batch.column("bucket").to_pylist()
            at = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[at]:
                    if held and ids[at] != name:
                        yield emit(held)
                        held = []
                    name = ids[at]
                    held.append(pa.Table.from_batches([batch.slice(at, i - at)]))
                    at = i
        if held:
            yield emit(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _NODE)


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two lists of turns."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x["id"] != y["id"], F.lit(True))), True)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("long")


def _buckets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each bucket: how many sequences and turns, members, least member, and the prefix they all share."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.size("turns")).alias("elements"), F.sum("n").alias("n"), F.min("first").alias("first"), F.min("turns").alias("low"), F.max("turns").alias("high"))
    found = found.withColumn("to", _common(F.col("low"), F.col("high")))
    return found.withColumn("shared", F.slice("low", F.lit(1), F.col("to").cast("int"))).drop("low", "high")


def prefix_trie(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of (conv_id, turns), and who ends where.

    Nodes: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved (bytes of
    last texts times members but one, over the subtree) and seq, the sequence that ends there or null. Ends: (seq, conv_ids in
    order). conv_id must be unique and not null; turns may be empty. No conversations, no nodes.

    A sequence's members meet in one row, as lists that each task has gathered beforehand."""
    grouped = sequences.groupBy("turns").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.array_sort(F.collect_list("conv_id")).alias("members"))
    whole = written(grouped.withColumn("seq", F.monotonically_increasing_id()), "distinct")
    rows = whole.select("seq", "n", "first", "turns")
    ends = whole.select("seq", "members")
    # The root is a large bucket, whatever its size.
    state = written(rows.withColumn("bucket", F.lit(0).cast("long")), "bucket")
    upper = _buckets(state, ["bucket"]).select("bucket", F.lit(None).cast("long").alias("upper"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("from"), "to", "n", "first", "shared")
    levels, done = [], []
    while True:
        upper = written(upper, "upper")
        facts = upper.select("bucket", F.col("to").alias("depth"), F.col("first").alias("parent"))
        here = unique_join(state, facts, "bucket")
        ending = here.filter(F.size("turns") == F.col("depth")).select("bucket", F.col("seq").alias("ends"))
        here = written(here.filter(F.size("turns") > F.col("depth")).withColumn("key", F.get("turns", F.col("depth").cast("int"))["id"]), "radix")
        levels.append((upper, written(ending, "ending")))
        if here.isEmpty():
            break
        below = _buckets(here, ["bucket", "key"]).withColumnsRenamed({"bucket": "upper"})
        below = written(below.withColumn("bucket", F.monotonically_increasing_id()), "below")
        small = (F.col("rows") == 1) | (F.col("rows") <= LOCAL) & (F.col("elements") <= LOCAL_TURNS)
        dealt = unique_join(here.withColumnRenamed("bucket", "upper"), below.select("upper", "key", "bucket", small.alias("small")), ["upper", "key"])
        done.append(written(_finished(dealt.filter("small").select("bucket", "parent", "depth", "upper", "seq", "n", "first", "turns")), "finished"))
        state = written(dealt.filter("not small").select("seq", "n", "first", "turns", "bucket"), "bucket")
        above = upper.select(F.col("bucket").alias("upper"), (F.col("to") + 1).alias("from"), F.col("first").alias("parent"))
        upper = below.filter(~small).join(above, "upper").select("bucket", "upper", "parent", "from", "to", "n", "first", "shared")
        if state.isEmpty():
            break
    return _added_up(levels, done), ends


def _added_up(levels: list[tuple[DataFrame, DataFrame]], done: list[DataFrame]) -> DataFrame:
    """All nodes: those of the small buckets, and those of large ones with the sums of what lies below them."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "seq"]
    out, tops = None, None
    for k in range(len(levels) - 1, -1, -1):
        upper, ending = levels[k]
        parts = [d.filter("top").select("bucket", "n_leaves", "saved") for d in done[k : k + 1]] + ([] if tops is None else [tops])
        if parts:
            below = parts[0]
            for p in parts[1:]:
                below = below.unionByName(p)
            sums = below.groupBy("bucket").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
            nodes = upper.join(sums, "bucket", "left")
        else:
            nodes = upper.withColumns({"n_children": F.lit(None).cast("long"), "n_leaves": F.lit(None).cast("long"), "below": F.lit(None).cast("long")})
        nodes = nodes.join(ending, "bucket", "left")
        # The shared prefix is a chain of nodes; what they save adds up from its end.
        cost = lambda d: F.when(d > 0, F.get("shared", (d - 1).cast("int"))["bytes"] * (F.col("n") - 1)).otherwise(F.lit(0).cast("long"))
        chain = F.reverse(F.sequence("from", "to"))
        start = F.array(F.struct(F.lit(-1).cast("long").alias("depth"), F.coalesce("below", F.lit(0)).cast("long").alias("saved")))
        sums = F.aggregate(chain, start, lambda a, d: F.concat(F.array(F.struct(d.alias("depth"), (a[0]["saved"] + cost(d)).alias("saved"))), a))
        nodes = written(nodes.withColumn("chain", F.filter(sums, lambda x: x["depth"] >= 0)), "chains")
        leaves = F.coalesce("n_leaves", F.lit(1)).cast("long")
        tops = nodes.filter("upper is not null").select(F.col("upper").alias("bucket"), leaves.alias("n_leaves"), F.col("chain")[0]["saved"].alias("saved"))
        last = F.col("x.depth") == F.col("to")
        each = nodes.withColumn("x", F.explode("chain")).select(
            F.col("first").alias("conv_id"), F.col("x.depth").alias("depth"), F.when(F.col("x.depth") == F.col("from"), F.col("parent")).otherwise(F.col("first")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), leaves.alias("n_leaves"), F.col("x.saved").alias("saved"), F.when(last, F.col("ends")).alias("seq"))
        out = each if out is None else out.unionByName(each)
    for d in done:
        out = out.unionByName(d.select(*columns))
    return out


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, turns): of each conversation c the first h = crc32(decimal c) % 9 turns of c - c % 5, then its own turns
    after the first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    rows = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    head = F.slice(F.coalesce("head", F.array().cast(_TURNS)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    own, _ = coded_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    nodes, ends = prefix_trie(rebuilt(own))
    said = ends.select("seq", F.sha2(F.array_join(F.transform("members", lambda c: c.cast("string")), ","), 256).alias("ends_sha256"))
    out = unique_join(nodes.filter("seq is not null"), said, "seq").drop("seq").unionByName(nodes.filter("seq is null").withColumn("ends_sha256", F.sha2(F.lit(""), 256)).drop("seq"))
    return out.withColumnRenamed("saved", "saved_tokens")


#: CRC-32 of a text of ASCII characters; its polynomial is a fixed value.
CRC32_SQL = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda ch: ord(ch)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT)"
OP12_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, ({CRC32_SQL.format("conv_id::VARCHAR")} % 9)::BIGINT AS h FROM (SELECT DISTINCT conv_id, n FROM t)),
x AS (SELECT c.conv_id, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, t.p + least(c.h, coalesce(b.n, 0)) - c.h, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h LEFT JOIN c b ON b.conv_id = c.base),
i AS (SELECT conv_id, p, strlen(text)::BIGINT AS bytes, dense_rank() OVER (ORDER BY role, text) AS id FROM x),
q AS (SELECT c.conv_id, coalesce(s.ids, []) AS ids, coalesce(s.sizes, []) AS sizes FROM c LEFT JOIN (SELECT conv_id, list(id ORDER BY p) AS ids, list(bytes ORDER BY p) AS sizes FROM i GROUP BY conv_id) s USING (conv_id)),
m AS (SELECT conv_id, ids, sizes, d FROM (SELECT conv_id, ids, sizes, unnest(range(0, len(ids) + 1)) AS d FROM q)),
n AS (SELECT ids[1 : d] AS prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(sizes[d]) * (count(*) - 1), 0) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ids) = d), '')) AS ends_sha256 FROM m GROUP BY ids[1 : d], d),
k AS (SELECT n.prefix[1 : depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT n.prefix, own, k.n_children IS NULL AS leaf, unnest(range(0, depth + 1)) AS d FROM n LEFT JOIN k ON k.prefix = n.prefix),
s AS (SELECT prefix[1 : d] AS prefix, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM u GROUP BY 1)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.prefix = n.prefix LEFT JOIN k ON k.prefix = n.prefix LEFT JOIN n up ON n.depth > 0 AND up.prefix = n.prefix[1 : n.depth - 1] AND up.depth = n.depth - 1
"""
