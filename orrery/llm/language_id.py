"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. A word that is not known falls back to its longest
known character n-grams (from 5 characters down to 1, with word edges), whose mean log frequencies it scores.
A text's language is the one with the largest mean over its words; the score is that language's share after a
softmax of these means. Counts come from a sample of at most `per_language` documents of each language (all, if
there are fewer), drawn by a hash of the text, so the model that tasks get has a bound that does not
grow with the corpus; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import kernels as K

PER_LANGUAGE = 1000
#: A word or n-gram is known if it was seen so often.
KNOWN = 2
LONGEST = 5
UNKNOWN = "und"
_FACTORS = np.cumprod(np.full(LONGEST, 0x9FB21C651E98DF25, np.uint64))


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _word_chars(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of the words, each led by a blank, with a blank at the end."""
    size = ends - starts + 1
    at = np.repeat(starts - 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
    edge = np.cumsum(size) - size
    at[edge] = 0
    raw = data[at]
    raw[edge] = 0x20
    return np.frombuffer((raw.tobytes() + b" ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)


def ngram_hashes(chars: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of every n-gram that lies in one word and its edges."""
    count = len(chars) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mixed = K.mix(chars)
    total = np.full(count, n, np.uint64)
    for j in range(n):
        total = total + mixed[j : j + count] * _FACTORS[j]
    blank = chars == 0x20
    seen = np.concatenate([[0], np.cumsum(blank)])
    i = np.arange(count)
    ok = seen[i + n - 1] - seen[np.minimum(i + 1, i + n - 1)] == 0 if n > 1 else ~blank[:count]
    return (seen[i + 1] - 1)[ok], K.mix(total[ok])


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """At most about per_language rows of each language, by a hash of their text; of copies that are drawn, one stays."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("rows"))
    # One row for each language: broadcast, as a join by language would move a third of all texts to one task.
    drawn = docs.join(F.broadcast(sizes), "lang").withColumn("draw", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 20)))
    return drawn.filter(F.col("draw") * F.col("rows") < F.lit(per_language << 20)).select("text", "lang").distinct()


class Model:
    """tables[0]: words, tables[n]: n-grams; each a sorted array of hashes and log frequencies by language."""

    def __init__(self, counts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], languages: list[str]):
        self.languages = languages
        self.tables = []
        for _, key, language, n in counts:
            keys, at = np.unique(key, return_inverse=True)
            table = np.zeros((len(keys), len(languages)))
            np.add.at(table, (at, language), n)
            known = table.sum(1) >= KNOWN
            logs = np.log((table[known] + 0.1) / (table.sum(0) + 0.1 * max(1, known.sum())))
            self.tables.append((keys[known], logs.astype(np.float32)))

    def find(self, level: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = self.tables[level]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def word_scores(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(hashes), len(self.languages)), np.float32)
        at, known = self.find(0, hashes)
        out[known] = self.tables[0][1][at[known]]
        open_ = np.flatnonzero(~known)
        if len(open_):
            chars = _word_chars(data, starts[open_], ends[open_])
            resolved = np.zeros(len(open_), bool)
            for n in range(LONGEST, 0, -1):
                owner, grams = ngram_hashes(chars, n)
                at, known = self.find(n, grams)
                known &= ~resolved[owner]
                owner, at = owner[known], at[known]
                count = np.bincount(owner, minlength=len(open_))
                now = count > 0
                for k in range(len(self.languages)):
                    total = np.bincount(owner, self.tables[n][1][at, k], len(open_))
                    out[open_[now], k] = total[now] / count[now]
                resolved |= now
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each text; -1 where nothing tells."""
        words = K.words_of(_lower(column), K.LETTERS)
        _, index, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        scores = self.word_scores(words.hashes[index], words.data, words.starts[index], words.ends[index])
        means = np.empty((len(column), len(self.languages)))
        size = np.diff(words.first)
        for k in range(len(self.languages)):
            total = np.concatenate([[0.0], np.cumsum(scores[inverse, k], dtype=np.float64)])
            means[:, k] = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(size, 1)
        best = means.argmax(1)
        share = 1 / np.exp(means - means.max(1, keepdims=True)).sum(1)
        return np.where(size > 0, best, -1), np.where(size > 0, share, 0.0)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from columns text and lang; rows with a null in either are left out. None without any row."""
    spark = labelled.sparkSession
    sample = _sample(labelled.filter("text is not null and lang is not null"), per_language).persist()
    languages = [r["lang"] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return None
    number = {v: i for i, v in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, limit=1 << 22):
                code = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
                words = K.words_of(_lower(part.column("text")), K.LETTERS)
                language = np.repeat(code, np.diff(words.first))
                for level in range(LONGEST + 1):
                    if level == 0:
                        hashes, owner = words.hashes, language
                    else:
                        at, hashes = ngram_hashes(_word_chars(words.data, words.starts, words.ends), level)
                        owner = language[at]
                    for k in range(len(languages)):
                        keys, n = np.unique(hashes[owner == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), level, np.int32)), pa.array(K.signed(keys)), pa.array(np.full(len(keys), k, np.int32)), pa.array(n.astype(np.int64))], ["level", "hash", "language", "n"])

    counted = sample.mapInArrow(count, "level int, hash long, language int, n long").groupBy("level", "hash", "language").agg(F.sum("n").alias("n"))
    both = counted.groupBy("level", "hash").agg(F.sum("n").alias("total"), F.collect_list(F.struct("language", "n")).alias("by")).filter(F.col("total") >= KNOWN)
    table = both.select("level", "hash", F.explode("by").alias("x")).select("level", "hash", "x.language", "x.n").toPandas()
    sample.unpersist()
    tables = []
    for level in range(LONGEST + 1):
        rows = table[table.level == level]
        tables.append((level, rows["hash"].to_numpy(np.int64).view(np.uint64), rows["language"].to_numpy(np.int64), rows["n"].to_numpy(float)))
    return Model(tables, languages)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1). A null text, or one without a letter, is `und` with score 0, as is
    every text when there is no model. Every row in gives a row; other columns stay, but for clashing names."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def guess(texts):
        import pandas as pd

        # One call sees a whole Arrow batch; slices bound what is held as arrays.
        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(texts, type=pa.large_string())], ["text"])
        out = []
        for part in K.slices(batch, limit=1 << 22):
            best, share = shared.value.predict(part.column("text"))
            out += [(shared.value.languages[b] if b >= 0 else UNKNOWN, float(s)) for b, s in zip(best, share, strict=True)]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    value = F.col(f"`{text}`")
    tells: Column = F.coalesce(value.rlike(r"\p{L}"), F.lit(False)) & F.lit(model is not None)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    mark = "_guess"
    while any(c.lower() == mark for c in docs.columns):
        mark = "_" + mark
    found = docs.withColumn(mark, guess(value))
    return found.withColumns({"lang_pred": F.when(tells, F.col(f"{mark}.lang_pred")).otherwise(UNKNOWN), "score": F.when(tells, F.col(f"{mark}.score")).otherwise(0.0)}).drop(mark)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Documents without an id are never learned from, so they count as held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = train(docs.filter(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
