"""From raw documents to packed sequences: every stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from orrery.llm.storage import written


#: Keys of dropped rows that are sent to all tasks; where there are more, rows and keys are shuffled.
SENT_KEYS = 1 << 17


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above their language's threshold go. Labels come from the table labels. Null and empty texts are
    scored as texts without words; rows that repeat are judged alike; no documents, no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.labelled_documents(docs, labels))
    scored = toxicity.score_texts(docs, model, lang="lang")
    return scored.filter(~F.col("toxic_flag")).select(*docs.columns)


def drop_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the largest doc_id stays; rows that repeat it too all stay."""
    return exact_dedup.exact_groups(docs).filter("kept").select(*docs.columns)


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row's own, and the name of that column: the doc_id where it is there and one row's alone,
    else a number behind the greatest doc_id (before the least one, if that is near the end of numbers), which is fixed
    by writing these rows."""
    key = "row_key"
    while any(c.lower() == key for c in docs.columns):
        key = "_" + key
    several = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "several")
    ends = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)).cast("long"), F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).first()
    lost = docs.filter("doc_id is null")
    alone = docs.filter("doc_id is not null")
    if not several.isEmpty():
        lost = lost.unionByName(alone.join(several, "doc_id", "left_semi"))
        alone = alone.join(several, "doc_id", "left_anti")
    place = F.monotonically_increasing_id()
    numbered = written(lost.withColumn(key, F.lit(ends[1] + 1) + place if ends[1] < 1 << 62 else F.lit(ends[0] - 1) - place), "numbered")
    alone = alone.withColumn(key, F.col("doc_id").cast("long"))
    # Most tables have no such rows: plans that read the rows stay small.
    return (alone if numbered.isEmpty() else alone.unionByName(numbered)), key


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs less the rows whose key is in gone. Rows stay where they are, texts and all, unless gone has over SENT_KEYS."""
    gone = written(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= SENT_KEYS else gone, key, "left_anti")


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the least doc_id stays.

    Texts without words are linked with none and stay. Rows without a doc_id, and those that share one, come after all
    others. A pair at the threshold is missed with a probability of 7e-5."""
    keyed, key = with_row_key(docs)
    gone = near_dedup.near_duplicates(keyed, key=key).filter(~F.col("kept")).select(F.col("doc_id").alias(key))
    return without(keyed, gone, key).select(*docs.columns)


def drop_benchmark_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark item's ten-word window go, whatever their doc_id. Null and empty texts
    stay, and so does everything if there is no benchmark."""
    keyed, key = with_row_key(docs)
    found = decontamination.contamination(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.filter("n_hit > 0").select(F.col("doc_id").alias(key))
    return without(keyed, gone, key).select(*docs.columns)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; every row is packed, a null or empty text as the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: A trained classifier and a packing have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
