"""Toxicity by a convolutional text classifier, trained in numpy.

Words (ASCII lower-cased letters and digits) are hashed into three embedding tables, by the whole word and by
its first 4 and 6 bytes, whose rows are put side by side: inflected forms share what their stem has
learnt, and two words are confused only if all hashes collide. Filters of several widths run over the word
vectors, each filter keeps its greatest response in the whole text (max pooling), and a logistic layer scores
them. Training reads at most max_train labelled documents (drawn by a hash of their id) in one
task; a share of them is held back to place the score's midpoint and, by language, the thresholds above
which a document counts as toxic. Bounds of the sample: MAX_TRAIN documents and MAX_TRAIN_BYTES of text. Training and scoring read every text whole, in runs of RUN words, since pooling
needs only the winning positions; scoring needs no shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import kernels as K
from orrery.llm.storage import written

#: Each table has 2 ** BITS rows of SIZE numbers.
BITS, SIZE, WIDTHS, FILTERS = 17, 6, (1, 2, 3), 16
STEMS = (None, 4, 6)
DIM = SIZE * len(STEMS)
MAX_TRAIN = 6000
#: Bytes of training texts in that task. Drawn documents that would go beyond it are left out, whole.
MAX_TRAIN_BYTES = 96 << 20
#: Document visits in training.
VISITS = 14_000
RUN = 1 << 15


def word_rows(column: pa.Array) -> list[np.ndarray]:
    """For each text, its words' rows in the tables."""
    words = K.words_of(column, K.ALNUM, lower=True)
    stems = [words.hashes, *(K.word_hashes(words.data, words.starts, np.minimum(words.ends, words.starts + n)) for n in STEMS[1:])]
    rows = (np.stack(stems, 1) >> np.uint64(64 - BITS)).astype(np.int32)
    return [rows[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]


class Cnn:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = DIM
        self.embed = rng.normal(0, 0.3, (len(STEMS), 1 << BITS, SIZE)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3 / np.sqrt(w), (w * d, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(0)
        self.thresholds: dict[str | None, float] = {}
        self.seen: dict[int, np.ndarray] = {}

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([table[rows[:, k]] for k, table in enumerate(self.embed)], 1)

    def pooled(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter and where it begins; a text shorter than a filter has response 0."""
        d = DIM
        values, places = [np.zeros(FILTERS, np.float32) for _ in WIDTHS], [np.full(FILTERS, -1) for _ in WIDTHS]
        widest = max(WIDTHS)
        for at in range(0, len(words), RUN):
            x = self.vectors(words[at : at + RUN + widest - 1])
            for i, w in enumerate(WIDTHS):
                n = min(RUN, len(x) - w + 1)
                if n <= 0:
                    continue
                response = x[:n] @ self.filters[i][:d]
                for j in range(1, w):
                    response += x[j : j + n] @ self.filters[i][j * d : (j + 1) * d]
                place = response.argmax(0)
                value = np.maximum(response[place, np.arange(FILTERS)] + self.bias[i], 0)
                better = value > values[i]
                values[i], places[i] = np.where(better, value, values[i]), np.where(better, place + at, places[i])
        return np.concatenate(values), np.concatenate(places)

    def logit(self, words: np.ndarray) -> float:
        return float(self.pooled(words)[0] @ self.out + self.base)

    def score(self, words: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(words), -30, 30))))

    def _step(self, name, rows, grad: np.ndarray, target: np.ndarray, rate: float) -> None:
        memory = self.seen.setdefault(name, np.full(target.shape, 1e-3, np.float32))
        memory[rows] += grad * grad
        target[rows] -= rate * grad / np.sqrt(memory[rows])

    def learn(self, words: np.ndarray, label: int, weight: float, rate: float) -> None:
        """One Adagrad step on one document; pooling sends the gradient to the winning positions only."""
        pooled, place = self.pooled(words)
        error = np.float32((1 / (1 + np.exp(-np.clip(pooled @ self.out + self.base, -30, 30))) - label) * weight)
        back = error * self.out * (pooled > 0)
        d = DIM
        touched, grads = [], []
        for i, w in enumerate(WIDTHS):
            at = slice(i * FILTERS, (i + 1) * FILTERS)
            live = np.flatnonzero(back[at])
            if not len(live):
                continue
            g, p = back[at][live], place[at][live]
            window = p[:, None] + np.arange(w)
            x = self.vectors(words[window.ravel()]).reshape(len(live), w * d)
            touched.append(window.ravel())
            grads.append((g[:, None] * self.filters[i][:, live].T).reshape(-1, d))
            self._step(f"f{i}", (slice(None), live), (x * g[:, None]).T, self.filters[i], rate)
            self._step(f"b{i}", live, g, self.bias[i], rate)
        self._step("out", slice(None), error * pooled, self.out, rate)
        self.base -= np.float32(rate * 0.1) * error
        if touched:
            rows = words[np.concatenate(touched)]
            grad = np.concatenate(grads)
            for k in range(len(STEMS)):
                each, at = np.unique(rows[:, k], return_inverse=True)
                total = np.zeros((len(each), SIZE), np.float32)
                np.add.at(total, at, grad[:, k * SIZE : (k + 1) * SIZE])
                self._step(f"e{k}", each, total, self.embed[k], rate)


def _best_threshold(scores: np.ndarray, labels: np.ndarray) -> float | None:
    """The midpoint between neighbours in score that makes the fewest errors; None without both labels."""
    if not (labels.any() and not labels.all()):
        return None
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    ok = np.concatenate([[True], s[1:] > s[:-1], [True]])
    at = np.flatnonzero(ok & (wrong == wrong[ok].min()))
    at = int(at[len(at) // 2])
    low, high = (s[at - 1] if at else s[0] - 1), (s[at] if at < len(s) else s[-1] + 1)
    return float(low + high) / 2


def _within(sizes: list[int], most: int) -> list[int]:
    """Places of the sizes that fit into `most` one after the other; what doesn't fit is passed over."""
    kept, total = [], 0
    for i, n in enumerate(sizes):
        if total + n <= most:
            kept.append(i)
            total += n
    return kept


def training_sample(labelled: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """(place, text, lang, toxic) of at most max_train documents with max_bytes of text, drawn by a hash of their id.

    Rows without a label, and null texts, are left out; of rows that repeat a document the largest label counts."""
    rows = labelled.filter("toxic is not null and text is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"), F.min("lang").alias("lang"))
    rows = written(rows, "labelled")
    # Numbers first: at most max_train ids with their texts' sizes come to the driver, then the texts that fit are picked.
    drawn = rows.select("doc_id", F.octet_length("text").alias("bytes"), F.xxhash64("doc_id").alias("draw")).orderBy("draw", "doc_id").limit(max_train).collect()
    kept = [(drawn[i].doc_id, place) for place, i in enumerate(_within([r.bytes for r in drawn], max_bytes))]
    kind = rows.schema["doc_id"].dataType.simpleString()
    chosen = labelled.sparkSession.createDataFrame(kept, f"own {kind}, place long")
    # A null doc_id is one document, as it is one group.
    return rows.join(F.broadcast(chosen), rows["doc_id"].eqNullSafe(F.col("own"))).select("place", "text", "lang", "toxic")


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, visits: int = VISITS, seed: int = 5, max_bytes: int = MAX_TRAIN_BYTES) -> Cnn:
    """A classifier from columns doc_id, text, toxic and, for thresholds alone, lang, of training_sample's rows.

    One task trains on the sample, which has a bound, and sends back the model; if its executor is lost, another one does.
    Without rows of both labels the classifier scores everything 0 (or 1, if all are toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, lang, label = [], [], []
        for batch in batches:
            for part in K.slices(batch, limit=1 << 19):
                texts += word_rows(part.column("text"))
            lang += batch.column("lang").to_pylist()
            label += [int(v > 0) for v in batch.column("toxic").to_pylist()]
        model = pickle.dumps(fit(texts, np.array(label, np.int64), lang, visits, seed))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    sample = training_sample(labelled, max_train, max_bytes).repartition(1).sortWithinPartitions("place")
    made = sample.mapInArrow(K.tidy(run), "model binary").first()
    # No rows may be no task.
    return pickle.loads(made.model) if made else fit([], np.zeros(0, np.int64), [], visits, seed)


def fit(texts: list[np.ndarray], label: np.ndarray, lang: list[str | None], visits: int, seed: int) -> Cnn:
    """The classifier of word rows, labels and languages."""
    model = Cnn(seed)
    if len(set(label.tolist())) < 2:
        model.out[:] = 0
        model.base = np.float32(30 if label.any() else -30)
        return model
    rng = np.random.default_rng(seed)
    held = np.arange(len(label)) % 7 == 3
    order = np.flatnonzero(~held)
    weight = {1: 0.5 / max(label[order].mean(), 1e-3), 0: 0.5 / max(1 - label[order].mean(), 1e-3)}
    epochs = max(3, min(40, visits // max(1, len(order))))
    for epoch in range(epochs):
        for i in rng.permutation(order):
            model.learn(texts[i], int(label[i]), weight[int(label[i])], 0.1 / (1 + 0.3 * epoch))
    calibrate = np.flatnonzero(held) if 0 < label[held].sum() < held.sum() else np.arange(len(label))
    logits = np.array([model.logit(texts[i]) for i in calibrate])
    shift = _best_threshold(logits, label[calibrate]) or 0.0
    model.base -= np.float32(shift)
    for value in {lang[i] for i in calibrate}:
        of = np.array([lang[i] == value for i in calibrate])
        best = _best_threshold(logits[of] - shift, label[calibrate][of])
        model.thresholds[value] = 0.5 if best is None else float(1 / (1 + np.exp(-np.clip(best, -4, 4))))
    model.seen.clear()
    return model


def score_texts(docs: DataFrame, model: Cnn, text: str = "text", lang: str | None = None) -> DataFrame:
    """docs with score (0 to 1) and, given a language column, toxic_flag by that language's threshold.

    Null and empty texts get the score of a text without words. Every row in gives a row; columns of these names
    are replaced."""
    docs = docs.drop("score", *(["toxic_flag"] if lang else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                out = []
                for part in K.slices(pa.RecordBatch.from_arrays([texts], ["text"]), limit=1 << 20):
                    out += [shared.value.score(rows) for rows in word_rows(part.column("text"))]
                yield pa.array(out, pa.float64())
        finally:
            K.give_back()

    docs = docs.withColumn("score", scores(F.col(f"`{text}`")))
    if lang:
        limit = F.lit(0.5)
        for value, threshold in model.thresholds.items():
            limit = F.when(F.col(f"`{lang}`").eqNullSafe(F.lit(value)), F.lit(threshold)).otherwise(limit)
        docs = docs.withColumn("toxic_flag", F.col("score") >= limit)
    return docs


def labelled_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Training rows: the labels drawn by a hash of their id, at most max_train, then their documents, half of
    them toxic if there are so many. Learned labels come only from rows whose crc32 of the id as text is no multiple of 5."""
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    labels = labels.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    drawn = [labels.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2) for y in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1])
    return docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "lang", "toxic")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Documents without an id are never learned from, so they count as held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(labelled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    scored = score_texts(docs.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
