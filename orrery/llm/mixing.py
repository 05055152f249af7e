"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

Every source gets a share of the mix by its weight, but no more than `epochs` times its own size. Where shares lie
above that, they are clamped and the excess goes to the others in proportion to their weights, again and again until
none is above. A source's target is then made of whole repetitions of all its documents and of a fraction of one more:
documents come in the order of a seeded hash until the fraction's words are used up, and the last takes part of its words.
Where the order crosses the fraction is found by descending the hash digit by digit over sums of sizes, so no task sorts
a source; equal rows at the crossing share what is left evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.storage import written
from orrery.plans.skew import unique_join
from orrery.sources.graphs import numbered

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, 20
#: Hex digits of a document's place in the order, and of one step down; rows left in a bucket that are sorted as they are.
DIGITS, STEP, SMALL = 16, 3, 4096
#: Tables of one row a source up to this many rows are broadcast: some 100 bytes each.
BROADCAST_ROWS = 10_000


WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sized(docs: DataFrame, seed: int, text: str, key: str, source: str) -> DataFrame:
    """(doc_id, source, name, size, place) of every row; name is the source, never null."""
    t, k, s = (F.col(f"`{c}`") for c in (text, key, source))
    place = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(k.cast("string"), F.lit("")), F.coalesce(t, F.lit(""))).cast("binary")), 1, DIGITS)
    return docs.select(k.alias("doc_id"), s.alias("source"), F.coalesce(F.concat(F.lit("="), s.cast("string")), F.lit("")).alias("name"), n_words(t).alias("size"), place.alias("place"))


def water_level(sources: DataFrame, total: float, epochs: int = EPOCHS) -> DataFrame:
    """sources (weight, source_size, ...) with target, doubles that add up to `total` unless all are clamped.

    A source is above its limit where weight * level is. Clamping raises the level of the others, so a round is one
    aggregate over the sources and ends when no more of them are above."""
    limit = F.col("source_size") * epochs
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > limit if clamped >= 0 else F.lit(False)
        now = sources.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("weights")).first()
        if now.n == clamped or not now.weights:
            break
        clamped, level, held, weights = now.n, (total - now.held) / now.weights, now.held, now.weights
    if clamped < 0:  # no sources
        return sources.withColumn("target", F.lit(0.0))
    share = F.col("weight") * F.lit(total - held) / F.lit(float(weights))
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(level) > limit, limit.cast("double")).otherwise(share))


def _by_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their source, one row each: broadcast if there are few, else hot sources only."""
    if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), "name")
    return unique_join(rows, facts, "name")


def _crossing(sized: DataFrame, plan: DataFrame, sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, prefix) where each source's order crosses its fraction, and (name, place, part) of the places that begin
    with the prefix: the words that each row there takes of its fraction.

    sums: (name, bucket, words, n) by the first STEP digits. A step goes down into the one bucket of each source that
    the fraction ends in, until that is small or has all digits."""
    digits, at = STEP, plan.select("name", F.lit("").alias("prefix"), F.col("fraction").alias("left"))
    while True:
        before = F.sum("words").over(W.partitionBy("name").orderBy("bucket")) - F.col("words")
        placed = _by_source(sums, at).withColumn("before", before)
        inside = (F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words"))
        at = written(placed.filter(inside).select("name", F.col("bucket").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "n"), "crossing")
        most = at.agg(F.max("n")).first()[0] or 0
        here = _by_source(sized, at).filter(F.substring("place", 1, digits) == F.col("prefix"))
        if most <= SMALL or digits >= DIGITS:
            break
        digits += STEP
        sums = written(here.groupBy("name", F.substring("place", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "sums")
        at = at.drop("n")
    groups = here.groupBy("name", "place", "left").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    before = F.sum("words").over(W.partitionBy("name").orderBy("place")) - F.col("words")
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("left") - before))
    return at.select("name", "prefix"), written(groups.select("name", "place", F.floor(part / F.col("n")).alias("part")), "parts")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size (words), source_size, target (of the source), whole (repetitions of the whole text), part (words
    of one more) and taken (whole * size + part) of every row.

    Sources by code point, null last, have the weights in turn, repeating; the mix has `share` times all words.
    A null text has no words. Rows that repeat are rows of their own and equal ones take equal parts; a null doc_id is an
    id like others. Other columns are left aside; an empty table gives none. The seed fixes the result."""
    sized = written(_sized(docs, seed, text, key, source), "sized")
    sums = written(sized.groupBy("name", F.substring("place", 1, STEP).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "sums")
    sizes = sums.groupBy("name").agg(F.sum("words").alias("source_size"))
    ordered = numbered(sizes.withColumn("last", F.col("name") == ""), ["last", "name"], "rank").drop("last")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(ordered.withColumn("weight", weight).drop("rank"), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    wanted = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0)
    plan = written(water_level(sources, share * total, epochs).withColumn("whole", whole.cast("long")).withColumn("fraction", wanted - F.col("whole") * F.col("source_size")), "plan")
    prefix, parts = _crossing(sized, plan, sums)
    facts = plan.select("name", "source_size", "target", "whole").join(prefix, "name", "left")
    rows = _by_source(sized, written(facts, "facts"))
    head = F.substring("place", 1, F.length("prefix"))
    rows = rows.withColumn("at", F.when(head == F.col("prefix"), F.col("place"))).withColumn("before", F.coalesce(head < F.col("prefix"), F.lit(False)))
    parts = parts.withColumnRenamed("place", "at")
    at = rows.filter("at is not null")
    rest = rows.filter("at is null").withColumn("part", F.when(F.col("before"), F.col("size")).otherwise(F.lit(0).cast("long")))
    out = unique_join(at, parts, ["name", "at"]).select(rest.columns).unionByName(rest)
    return out.select("doc_id", "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def repetitions(docs: DataFrame, mixed: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, repetition, text): the mix's texts, one row for each repetition; the last may be a text's first words, joined by a blank.

    docs must have unique ids, none null."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(mixed.select("doc_id", "size", "whole", "part"), "doc_id")
    times = F.col("whole") + (F.col("part") > 0).cast("long")
    each = rows.filter(times > 0).withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = (F.col("repetition") > F.col("whole")) & (F.col("part") < F.col("size"))
    return each.select("doc_id", "repetition", F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")).otherwise(F.col("text")).alias("text"))


def op11_mixing_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {DIGITS}) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level FROM s
  WINDOW p AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight * level > 2 * source_size AS clamped FROM l),
t AS (SELECT source, source_size, CASE WHEN clamped THEN 2.0::DOUBLE * source_size ELSE weight * ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (clamped) OVER (), 0)) / sum(weight) FILTER (NOT clamped) OVER () END AS target FROM c),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
g AS (SELECT source, place, sum(size)::BIGINT AS words, count(*) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) - sum(size) AS before FROM d GROUP BY source, place),
p AS (SELECT g.source, place, whole, source_size, target, greatest(0, least(words, floor(target)::BIGINT - whole * source_size - before))::BIGINT // n AS part FROM g JOIN w ON w.source IS NOT DISTINCT FROM g.source)
SELECT d.doc_id, d.size, p.source_size, p.target, (whole * d.size + part)::BIGINT AS taken
FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.place = d.place
"""
