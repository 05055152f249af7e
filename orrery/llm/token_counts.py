"""Token counts of a byte-fallback BPE piece model by rank-synchronous array merging.

A text is cut into pre-tokens (a run of blanks and what follows it up to the next blank; no piece of the
vocabulary crosses such a cut). The distinct pre-tokens of a batch are held as one ragged array of symbols. In
each round all sequences whose lowest-ranked pair has the round's rank merge its pairs at once, so rounds are as many
as there are ranks in use, however long a sequence is; what survives is counted. Symbols outside the vocabulary
count as their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import kernels as K

BLANK = "▁"
NEVER = np.int64(1) << 40
_models: dict[str, Pieces] = {}


class Pieces:
    """Pair table of a sentencepiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        own = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in own}
        if any(BLANK in p.lstrip(BLANK) for p in ids):
            raise ValueError("a piece has a blank after other characters, so texts can't be cut at blanks")
        scores = np.array([model.get_score(i) for i in range(size)])
        self.rank = np.searchsorted(np.unique(-scores), -scores).astype(np.int64)
        self.bits = size.bit_length()
        self.char = np.full(0x110000, -1, np.int64)
        pairs: dict[int, int] = {}
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
            for k in range(1, len(piece)):
                left, right = ids.get(piece[:k]), ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << self.bits | right] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in sorted(pairs)], np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, or -1."""
        key = np.where((left < 0) | (right < 0), -1, left << self.bits | right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    def ranks(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.rank[piece], NEVER)


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


class Ranks:
    """Positions of pairs waiting by rank, lowest rank first."""

    def __init__(self):
        self.queue: list[int] = []
        self.waiting: dict[int, list[np.ndarray]] = {}

    def add(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        heads = [0, *cuts.tolist(), len(ranks)]
        for at, to in zip(heads, heads[1:], strict=False):
            rank = int(ranks[at])
            if rank in self.waiting:
                self.waiting[rank].append(positions[at:to])
            else:
                self.waiting[rank] = [positions[at:to]]
                heapq.heappush(self.queue, rank)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.queue)
        return rank, np.unique(np.concatenate(self.waiting.pop(rank)))


def count_sequences(symbols: np.ndarray, costs: np.ndarray, first: np.ndarray, model: Pieces) -> np.ndarray:
    """Tokens of each sequence symbols[first[i]:first[i+1]]; costs: what a symbol counts.

    A round takes the lowest rank that waits and merges its pairs in all sequences at once, leftmost first where two
    overlap. In a sequence where a merge makes a pair of that rank or a lower one, the pairs behind it wait, as the new
    pair comes before them; so every sequence sees its merges in the order of one by one."""
    n = len(symbols)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # One place behind the end stands for no neighbour; its symbol joins with none.
    symbol, alive = np.append(symbols, -1), np.ones(n + 1, bool)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    last = first[1:][np.diff(first) > 0] - 1
    after[last], before[first[:-1][np.diff(first) > 0]] = n, n
    made = model.merge(symbol[:n], symbol[after[:n]])
    rank = np.append(model.ranks(made), NEVER)
    made = np.append(made, -1)
    ranks = Ranks()
    some = np.flatnonzero(rank < NEVER)
    if len(some):
        ranks.add(some, rank[some])
    while ranks.queue:
        now, at = ranks.pop()
        at = at[alive[at] & (rank[at] == now)]
        if not len(at):
            continue
        # Of overlapping pairs in a row, every other one.
        chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
        head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - head) % 2 == 0]
        while True:
            right, piece = after[at], made[at]
            left, further = before[at], after[right]
            beside = np.concatenate([[False], further[:-1] == at[1:]])
            before_piece = np.where(beside, np.concatenate([[-1], piece[:-1]]), symbol[left])
            to_left, to_right = model.merge(before_piece, piece), model.merge(piece, symbol[further])
            low = np.minimum(model.ranks(to_left), model.ranks(to_right)) <= now
            if not low.any():
                break
            whose = owner[at]
            passed = np.cumsum(low) - low
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], whose[1:] != whose[:-1]]), np.arange(len(at)), 0))
            go = passed == passed[begin]
            if go.all():
                break
            ranks.add(at[~go], np.full((~go).sum(), now))
            at = at[go]
        symbol[at] = piece
        alive[right] = False
        after[at] = further
        inner = further < n
        before[further[inner]] = at[inner]
        # The pair that begins at a merged symbol: with the next one, merged as well or not.
        joined = np.append(beside[1:], False)
        made[at] = np.where(joined, np.append(to_left[1:], -1), to_right)
        outer = (left < n) & ~beside
        made[left[outer]] = to_left[outer]
        changed = np.concatenate([at, left[outer]])
        fresh = model.ranks(made[changed])
        rank[changed] = fresh
        wait = fresh < NEVER
        if wait.any():
            ranks.add(changed[wait], fresh[wait])
    cost = np.where(symbol[:n] >= 0, 1, costs)
    total = np.concatenate([[0], np.cumsum(np.where(alive[:n], cost, 0))])
    return total[first[1:]] - total[first[:-1]]


def count_texts(column: pa.Array, model: Pieces) -> np.ndarray:
    """Tokens of each text; none for null and empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.replace_substring(column, BLANK, " ")
    column = pc.if_else(pc.greater(pc.binary_length(column), 0), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())), column)
    data, offsets = K.text_bytes(column)
    if not len(data):
        return np.zeros(len(column), np.int64)
    blank = data == 0x20
    before = np.concatenate([[False], blank[:-1]])
    begins = offsets[:-1][np.diff(offsets) > 0]
    before[begins] = False
    starts = np.flatnonzero(blank & ~before)
    ends = np.append(starts[1:], len(data))
    # Pre-tokens follow each other without gaps; they are told apart by their bytes.
    words, inverse = K.distinct_words(data, starts, ends)
    raw, bound = K.text_bytes(words)
    size = np.diff(bound)
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first = heads[np.concatenate([[0], np.cumsum(size)])]
    code[code == 0x20] = ord(BLANK)
    symbols = model.char[code]
    costs = np.where(symbols >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
    counts = count_sequences(symbols.copy(), costs, first, model)
    total = np.concatenate([[0], np.cumsum(counts[inverse])])
    word = np.searchsorted(starts, offsets)
    return total[word[1:]] - total[word[:-1]]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    Null text counts as empty (0 tokens). Keys may be null or repeat: a row comes out for each row in.
    model_path is a sentencepiece file at the same place on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            for part in K.slices(batch, limit=1 << 23):
                n_bytes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                n = count_texts(part.column("text"), model)
                yield pa.RecordBatch.from_arrays([part.column("key"), n_bytes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
