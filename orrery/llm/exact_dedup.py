"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text is cut where its content says so (a sentence mark or a line end once a chunk has min_chunk
characters, else at max_chunk), so equal texts have equal chunks. Each chunk text gets an identifier, and
one job verifies that an identifier stands for one chunk text only: each chunk text moves at most once, after
map-side combining. From then on only recipes, the ordered identifier lists (some 16 bytes for half a
kilobyte of text), move. Should two chunk texts ever share an identifier, the documents that hold it are
compared by whole text instead, so results stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.storage import written
from orrery.plans.skew import unique_join

MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """The text's chunks in order; joined they are the text. An empty text has none."""
    pattern = f"(?s).{{{min_chunk},{max_chunk}}}?[.!?\\n]|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk))


def collisions(texts: DataFrame, name=identifier) -> DataFrame:
    """Identifiers (column id) that stand for more than one chunk text, of a frame with a column chunks."""
    each = texts.select(F.explode("chunks").alias("chunk")).select(name(F.col("chunk")).alias("id"), "chunk")
    return each.groupBy("id", "chunk").agg(F.count("*").alias("n")).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", name=identifier, carry: bool = True) -> DataFrame:
    """docs with keep_id, group_size and kept: of equal texts the row with the largest key stays.

    Null text counts as empty; empty texts equal each other. Keys that are null count as smallest; rows that
    repeat the largest key and its text are all kept (they are one document listed twice). Other columns stay;
    columns already called keep_id, group_size or kept are replaced. An empty table gives an empty table.

    Groups are found on recipes and keys alone. The rows of a hot group stay where they are, as their group is
    broadcast. With carry=False the text is left out of the result, and no text is read a second time for it.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    recipe, whole, value, doubt = (mark + c for c in ("recipe", "whole", "value", "doubt"))
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    clash = collisions(docs.select(chunks(source).alias("chunks")), name)
    cut = docs.withColumn(recipe, F.transform(chunks(source), name))
    doubted = F.lit(False)
    if not clash.isEmpty():
        held = cut.select(recipe).distinct().select(recipe, F.explode(recipe).alias("id"))
        doubtful = held.join(clash, "id", "left_semi").select(recipe).distinct()
        cut = cut.join(doubtful.withColumn(doubt, F.lit(True)), recipe, "left")
        doubted = F.coalesce(F.col(doubt), F.lit(False))
    cut = cut.withColumn(whole, F.when(doubted, source).otherwise(F.lit(""))).drop(doubt)
    if not carry:
        cut = written(cut.drop(text), "recipes")
        slim = cut.select(recipe, whole, F.col(f"`{key}`").alias(value))
    else:
        slim = written(cut.select(recipe, whole, F.col(f"`{key}`").alias(value)), "recipes")
    groups = written(slim.groupBy(recipe, whole).agg(F.max(value).alias("keep_id"), F.count("*").alias("group_size")), "groups")
    joined = unique_join(cut, groups, [recipe, whole], counts="group_size").drop(recipe, whole)
    return joined.withColumn("kept", F.col(f"`{key}`").eqNullSafe(F.col("keep_id")))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hashed = F.sha2(F.coalesce("text", F.lit("")), 256)
    slim = exact_groups(docs.withColumn("text_sha256", hashed), carry=False)
    return slim.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
