"""Packing of tokenized documents into sequences by cutting-stock column generation.

A document is cut into full pieces and a rest. The lengths of all pieces form a histogram of at most
max_tokens entries, whatever the size of the corpus; only it reaches the driver. There a linear program over
packing patterns is solved by column generation: the dual prices of the lengths go into a knapsack dynamic
program whose best pattern enters the basis until none pays. Pattern counts are rounded down, what is left is
packed greedily into further patterns, and pieces, ranked within their length class, take their places in the
patterns by rank. The ranks come from counts by (class, bucket), so a length that a third of all pieces share is
spread over many tasks.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm import kernels as K
from orrery.llm.storage import written

MAX_TOKENS = 1024
END_ID = 0
#: Length classes of the linear program: lengths are rounded up to MAX_TOKENS / CLASSES.
CLASSES = 256
BUCKET_ROWS = 20_000
END_OF_TEXT = "<|endoftext|>"
_UNICODE_SPACE = "[\u0085   -     　\x1c-\x1f]"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, bucket long"
_encoders: dict[str, ByteBpe] = {}


class ByteBpe:
    """Token ids of whole texts. Distinct blank-led words of a batch are encoded once, in one call."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
        self.size = np.zeros(len(ranks) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.size[len(ranks)] = len(END_OF_TEXT)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode(text, allowed_special="all"), np.uint32)

    def batch(self, column: pa.Array) -> list[np.ndarray]:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        # Blanks outside ASCII may join a run of blanks, and special strings are found before words are.
        odd = pc.or_(pc.match_substring_regex(column, _UNICODE_SPACE), pc.match_substring(column, END_OF_TEXT)).to_numpy(zero_copy_only=False)
        data, offsets = K.text_bytes(column)
        n = len(data)
        blank = ~K.NOT_SPACE[data]
        before = np.zeros(n, bool)
        before[1:] = blank[:-1]
        begins = offsets[:-1][np.diff(offsets) > 0]
        cut = blank & ~before
        cut[begins] = True
        starts = np.flatnonzero(cut)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(column)
        ends = np.append(starts[1:], n)
        # Words follow each other without gaps, so each begins where the one before ends; they are told apart by their bytes.
        words, inverse = K.distinct_words(data, starts, ends)
        raw, bound = K.text_bytes(words)
        s, e = bound[:-1], bound[1:]
        word_blank = ~K.NOT_SPACE[raw]
        # In one string, each word must begin with a blank after another's last non-blank; others go alone.
        joined = word_blank[s] & ~word_blank[e - 1]
        size = np.where(joined, e - s, 0)
        at = K.ragged(s, size)
        ids = self.encoder.encode_to_numpy(raw[at].tobytes().decode(), disallowed_special=()).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        token_end = np.cumsum(self.size[ids])
        bounds = np.concatenate([[0], np.searchsorted(token_end, np.cumsum(size), "right")])
        begin, count = bounds[:-1].copy(), np.diff(bounds)
        alone, parts, total = np.flatnonzero(~joined), [ids], len(ids)
        for i in alone:
            got = np.array(self.encoder.encode_ordinary(raw[s[i] : e[i]].tobytes().decode()), np.uint32)
            begin[i], count[i] = total, len(got)
            parts.append(got)
            total += len(got)
        ids = np.concatenate(parts)
        n_each = count[inverse]
        flat = ids[K.ragged(begin[inverse], n_each)]
        bound = np.concatenate([[0], np.cumsum(n_each)])[np.searchsorted(starts, offsets)]
        return [self.whole(column[i].as_py()) if odd[i] else flat[bound[i] : bound[i + 1]] for i in range(len(column))]


def encoder(ranks_path: str) -> ByteBpe:
    if ranks_path not in _encoders:
        _encoders[ranks_path] = ByteBpe(ranks_path)
    return _encoders[ranks_path]


def cut_pieces(docs: DataFrame, ranks_path: str, max_tokens: int = MAX_TOKENS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of every document: full ones and the rest, which is cut once more if over half a sequence, since
    long rests seldom have partners. An empty or null text is the end id alone."""
    grain = max(1, max_tokens // CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path)
        for batch in batches:
            for part in K.slices(batch):
                out = []
                for key_, ids in zip(part.column("key").to_pylist(), bpe.batch(part.column("text")), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    whole = len(ids) // max_tokens * max_tokens
                    cuts = [*range(0, whole, max_tokens), *range(whole, len(ids), max_tokens // 2), len(ids)]
                    for at, to in zip(cuts, cuts[1:], strict=False):
                        piece = ids[at:to]
                        out.append((key_, at, len(piece), zlib.crc32(piece), len(ids), -(-len(piece) // grain), zlib.crc32(f"{key_} {at}".encode())))
                columns = list(zip(*out, strict=True)) or [()] * 7
                types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "bucket"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(K.tidy(run), _PIECE)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, by dynamic programming over the capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, "right")
        best[room] = best[room - 1]
        if fits:
            value = best[room - sizes[:fits]] + prices[:fits]
            at = int(value.argmax())
            if value[at] > best[room] + 1e-12:
                best[room], took[room] = value[at], at
    count, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            count[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), count


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used so that every demand is met exactly, fractionally and with
    few uses: a revised simplex method whose entering columns the knapsack prices. uses / value bounds the
    optimum from below; within `gap` of it (or half a sequence), or after `rounds`, the feasible basis is taken."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    uses = inverse @ demand
    for _ in range(rounds):
        value, column = knapsack(sizes, np.maximum(inverse.sum(0), 0), capacity)
        total = uses.sum()
        if value <= 1 + 1e-7 or total - total / value < max(0.5, gap * total):
            break
        step = inverse @ column
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, uses / np.where(ok, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        uses = np.maximum(uses - step * ratio[out], 0)
        uses[out] = max(ratio[out], 0)
    return basis[:, :n], uses


def pack_histogram(histogram: dict[int, int], capacity: int = CLASSES) -> list[tuple[dict[int, int], int]]:
    """(pattern as class: pieces, times used) that hold exactly the pieces of the histogram."""
    sizes = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(k)] for k in sizes], np.int64)
    columns, uses = solve_patterns(sizes, left.astype(float), capacity)
    plan = []
    for column, times in zip(columns.T.round().astype(np.int64), np.floor(uses + 1e-6).astype(np.int64), strict=True):
        used = column > 0
        times = int(min(times, (left[used] // column[used]).min())) if used.any() else 0
        if times > 0:
            left -= column * times
            plan.append(({int(sizes[i]): int(column[i]) for i in np.flatnonzero(used)}, times))
    while left.any():
        room, column = capacity, np.zeros_like(left)
        for i in range(len(sizes) - 1, -1, -1):
            column[i] = min(left[i], room // sizes[i])
            room -= column[i] * sizes[i]
        used = column > 0
        times = int((left[used] // column[used]).min())
        left -= column * times
        plan.append(({int(sizes[i]): int(column[i]) for i in np.flatnonzero(used)}, times))
    return plan


class Places:
    """Where the piece of a given class and rank goes."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        rows, sequence, taken = [], 0, {}
        for pattern, times in plan:
            for size, count in pattern.items():
                rows.append((size, taken.get(size, 0), count, sequence))
                taken[size] = taken.get(size, 0) + count * times
            sequence += times
        rows.sort()
        self.size, self.begin, self.count, self.sequence = np.array(rows, np.int64).reshape(-1, 4).T
        self.key = (self.size << 48) | self.begin

    def sequence_of(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, (size.astype(np.int64) << 48) | rank, "right") - 1
        return self.sequence[at] + (rank - self.begin[at]) // self.count[at]


def pack(docs: DataFrame, ranks_path: str, max_tokens: int = MAX_TOKENS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    Each id of each document lies in exactly one piece; a sequence holds at most max_tokens ids, gapless from 0.
    Null and empty texts are one id long. Keys may be null or repeat; every row is packed. An empty table gives none.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, ranks_path, max_tokens, text, key), "pieces")
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    buckets = 1 + sum(histogram.values()) // BUCKET_ROWS
    grain = max(1, max_tokens // CLASSES)
    places = spark.sparkContext.broadcast(Places(pack_histogram(histogram, max_tokens // grain)))
    pieces = pieces.withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    before = pieces.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = before.select("class", "bucket", (F.sum("n").over(W.partitionBy("class").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(before, ["class", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("rank") + F.col("before")).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places.value.sequence_of(size, at))], [*batch.schema.names, "sequence_id"])

    placed = ranked.mapInArrow(K.tidy(assign), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, rank long, sequence_id long")
    order = W.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    offset = F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
