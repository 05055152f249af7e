"""Chat formatting of reply trees.

Messages name the message they reply to. Iterative self-joins on the reply link enumerate root-to-leaf paths:
each round doubles the distance that every message has climbed, so a chain of n messages takes log2(n) joins and
not n. Branches are ranked by their mean score, and each chosen path becomes one formatted conversation with the
spans of the assistant's text. Control strings inside texts are escaped by a backslash after each `<`, `[` and
`\\` of a text, which reading undoes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.storage import written

BEGIN, ROLE_END, TURN_END, END = "<s>", "[/ROLE]", "[/TURN]", "</s>"
ROLE = "[ROLE]"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def enumerate_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, id, depth, path_rank) of every message on a chosen root-to-leaf path.

    messages: tree, id, parent (null at a root), score (null counts as 0). A parent that isn't there makes its
    message a root; messages on a cycle of replies have no root and are left out. Paths rank by mean score, then by
    leaf; best=None keeps all. (tree, id) must be unique; an empty table gives none.
    """
    nodes = written(messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "nodes")
    there = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    nodes = nodes.join(there, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("parent"), "score")
    # climbed: from id, `size` messages up to and without `up` (null: past the root) sum to `total`.
    climbed = written(nodes.select("tree", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"), F.col("score").alias("total")), "climbed")
    jumps = [climbed.select("tree", "id", "up")]
    rounds, limit = 0, max(1, nodes.count())
    while climbed.filter("up is not null").limit(1).count() and 1 << rounds <= limit:
        higher = climbed.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("size").alias("size2"), F.col("total").alias("total2"))
        # Messages that are past the root stay as they are: only those still climbing are joined.
        further = climbed.filter("up is not null").join(higher, ["tree", "up"]).select("tree", "id", F.col("up2").alias("up"), (F.col("size") + F.col("size2")).alias("size"), (F.col("total") + F.col("total2")).alias("total"))
        climbed = written(climbed.filter("up is null").unionByName(further), "climbed")
        jumps.append(climbed.select("tree", "id", "up"))
        rounds += 1
    replied = nodes.filter("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    leaves = climbed.filter("up is null").join(replied, ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "size", (F.col("total") / F.col("size")).alias("mean"))
    if best == 1:
        first = F.max(F.struct("mean", (-F.col("leaf")).alias("order"), "size")).alias("x")
        leaves = leaves.groupBy("tree").agg(first).select("tree", (-F.col("x.order")).alias("leaf"), F.col("x.size").alias("size"), F.lit(1).alias("path_rank"))
    else:
        leaves = leaves.withColumn("path_rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("mean"), "leaf")))
        leaves = leaves.drop("mean") if best is None else leaves.filter(F.col("path_rank") <= best).drop("mean")
    # Each round adds, for every member of a path so far, the message 2**k further up.
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("id"), "path_rank", (F.col("size") - 1).alias("depth"))
    for k, jump in enumerate(jumps):
        up = jump.filter("up is not null")
        more = paths.join(up, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), "path_rank", (F.col("depth") - (1 << k)).alias("depth"))
        paths = written(paths.unionByName(more), "paths")
    return paths


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, leaf, path_rank, formatted, loss_spans) of each path; messages: tree, id, role, text (null: empty).

    loss_spans are the code points (start, stop) of the assistant's escaped texts in `formatted`. A path is one row,
    so one task holds a whole conversation; nothing else is gathered.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turns = paths.join(messages.select("tree", "id", role.alias("role"), text.alias("text")), ["tree", "id"])
    head = F.concat(F.lit(ROLE), F.col("role"), F.lit(ROLE_END))
    turns = turns.select("tree", "leaf", "path_rank", F.struct("depth", head.alias("head"), "text", (F.col("role") == LEARNT).alias("learnt")).alias("turn"))
    rows = turns.groupBy("tree", "leaf", "path_rank").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(TURN_END))), ""), F.lit(END))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["text"]) + len(TURN_END)).alias("at"),
            F.when(t["learnt"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(t["head"])).alias("start"), (a["at"] + F.length(t["head"]) + F.length(t["text"])).alias("stop"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return rows.select("tree", "leaf", "path_rank", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    inner = F.substring(formatted, len(BEGIN) + len(ROLE) + 1, F.length(formatted) - len(BEGIN) - len(ROLE) - len(TURN_END) - len(END))
    turns = F.split(inner, r"\[/TURN\]\[ROLE\]")
    return F.transform(turns, lambda t: F.struct(unescape(F.substring_index(t, ROLE_END, 1)).alias("role"), unescape(F.substring_index(t, ROLE_END, -1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int")))), "")


def chain_messages(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: each turn replies to the one before. Turns sort by number, role and text, so
    ties and repeated rows have their place; null conv_id is one conversation of its own."""
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select(F.coalesce("tree", F.lit(-(1 << 63))).alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*own.columns).unionByName(own)
    messages = written(chain_messages(talks), "messages")
    done = format_paths(messages, enumerate_paths(messages))
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.select(F.when(F.col("tree") != -(1 << 63), F.col("tree")).alias("conv_id"), turns.alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_ESCAPED = r"regexp_replace(coalesce({}, ''), '([<\[\\])', '\1\\', 'g')"
OP3_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(BEGIN) + len(END)} + sum({len(ROLE) + len(ROLE_END) + len(TURN_END)} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
