"""Small numpy helpers over Arrow batches of texts: words, word hashes, n-gram hashes.

All hashes are 64-bit and depend on content and a seed only, so tasks on any executor agree. Operators that compare
by hashes draw the seed once for each job; models, which only bin words, use seed 0.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BYTES = np.arange(256)
#: Byte classes. UTF-8 bytes of non-ASCII characters are at 0x80 and above.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
LETTERS = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
ALNUM = LETTERS | ((_BYTES >= 0x30) & (_BYTES <= 0x39))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

#: Words beyond so many bytes are hashed by a library, one by one; shorter ones in rounds of eight bytes.
_ROUNDS_TO = 512
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def draw_seed() -> int:
    """A seed for the hashes of one job, drawn on the driver, so that no text can be made to clash beforehand."""
    return secrets.randbits(63)


def give_back() -> None:
    """Freed memory goes back to the system, as far as that can be asked for: the worker goes on to other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task over batches, which gives back its memory when it ends: else idle workers hold it beside later stages."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` text bytes, each of at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in a row, and where each begins (one more entry than texts). Null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a batch: bytes, begin and end of each word, first word of each text, and a hash of each word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)


def words_of(column: pa.Array, members: np.ndarray, lower: bool = False, hashes: bool = True, seed: int = 0) -> Words:
    data, offsets = text_bytes(column)
    return words_in(data, offsets, members, lower, hashes, seed)


def words_in(data: np.ndarray, offsets: np.ndarray, members: np.ndarray, lower: bool = False, hashes: bool = True, seed: int = 0) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = members[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = offsets[offsets < n]
    before[edges] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    found = Words(data, starts, ends, np.searchsorted(starts, offsets))
    if hashes:
        found.hashes = word_hashes(data, starts, ends, seed)
    return found


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the words by length and bytes, eight bytes a round; every round mixes all bits, so clashes can't be
    built without the seed."""
    out = mix((ends - starts).astype(U) * U(0x9E3779B97F4A7C15) + U(seed))
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    size = ends - starts
    for i in np.flatnonzero(size > _ROUNDS_TO).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "big")).digest()
        out[i] = int.from_bytes(digest, "big")
    live = np.flatnonzero((size > 0) & (size <= _ROUNDS_TO))
    at = starts[live]
    while len(live):
        left = ends[live] - at
        block = eights[at].view("<u8")[:, 0] & _MASK[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ block)
        more = left > 8
        live, at = live[more], at[more] + 8
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + sizes[i] of all i in a row."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


def binary_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[starts[i]:ends[i]] of all i as Arrow binaries."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if (sizes > 0).all() and (starts[1:] >= ends[:-1]).all():
        # Words one after the other: a flag for each byte, not a number of eight bytes.
        edges = np.zeros(len(data) + 1, np.int8)
        edges[starts] += 1
        edges[ends] -= 1
        kept = data[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
    else:
        kept = data[ragged(starts, sizes)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different words, by their bytes, and each word's number among them."""
    coded = binary_array(data, starts, ends).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def grams(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k words; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total, factor = words[:n] * U(1), 1
    for j in range(1, k):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total = total + words[j : j + n] * U(factor)
    return mix(total + U(seed * 0xA0761D6478BD642F % (1 << 64)))


def window_hash(words: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each row of words."""
    out = np.full(len(words), mix(np.array([seed], U))[0], U)
    for j in range(words.shape[1]):
        out = mix(out ^ words[:, j]) + U(j)
    return out


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Least (or greatest) of each `width` values in a row, by doubling."""
    f, n = np.minimum if least else np.maximum, len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = f(values[:-size], values[size:])
        size *= 2
    return f(values[:n], values[width - size : width - size + n]) if size < width else values[:n]


def minimisers(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each window of `width` grams, and the positions that are least in some window."""
    least = sliding(hashes, width)
    if not len(least):
        return least, np.zeros(0, np.int64)
    edge = np.zeros(width - 1, U)
    return least, np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, least=False) == hashes)


def per_doc(words: Words) -> Iterator[tuple[int, np.ndarray]]:
    for i in range(len(words.first) - 1):
        yield i, words.hashes[words.first[i] : words.first[i + 1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
