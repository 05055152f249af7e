"""Content-selected anchors that recur in the corpus, and documents dealt into shards of bounded size.

Of each `window` words in a row the least hash of its `k`-word phrases is an anchor: equal windows have equal
anchors wherever they stand, and only a fraction of all positions is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm import kernels as K

#: Text bytes of a shard.
SHARD_BYTES = 4 << 20
#: Stands for a null id inside; smaller than all others.
NO_ID = -(1 << 63)


def sharded(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, text, shard): shards of about SHARD_BYTES text, by a hash of id and length; null ids become NO_ID, and rows
    without an id are dealt by their place."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    deal = F.xxhash64(F.col(f"`{key}`"), F.length(F.col(f"`{text}`")))
    lost = F.xxhash64(F.length(F.col(f"`{text}`")), F.monotonically_increasing_id())
    shard = F.pmod(F.when(F.col(f"`{key}`").isNull(), lost).otherwise(deal), F.lit(1 + size // SHARD_BYTES)).cast("int")
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text}`").alias("text"), shard.alias("shard"))


def _anchors(part: pa.RecordBatch, k: int, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and hash of a slice's anchors."""
    words = K.words_of(part.column("text"), K.NOT_SPACE, seed=seed)
    shard = part.column("shard").to_numpy()
    owner, found = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    for i, own in K.per_doc(words):
        if len(own) >= window:
            hashes = K.grams(own, k)
            _, p = K.minimisers(hashes, window - k + 1)
            owner.append(np.full(len(p), shard[i], np.int32))
            found.append(hashes[p])
    return np.concatenate(owner), np.concatenate(found)


def told_apart(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index of an anchor, shard, salt, n) to count a slice's anchors by, given their codes and shards.

    An anchor that is alone in the slice is counted under salt 0 with its shard. One that recurs in the slice needs no
    count: each of its shards gets a row of its own salt, and one row without a shard counts for the others. So the
    rows that meet by an anchor under salt 0 are at most one a slice, however common it is."""
    order = np.lexsort((owner, code))
    c, o = code[order], owner[order]
    new = np.concatenate([[True], c[1:] != c[:-1]])[: len(c)]
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(c)))
    many = np.repeat(n > 1, n)
    each = np.flatnonzero(many & np.concatenate([[True], new[1:] | (o[1:] != o[:-1])])[: len(c)])
    index = np.concatenate([order[head], order[each]])
    shard = np.concatenate([np.where(n > 1, -1, o[head]), o[each]])
    salt = np.concatenate([np.zeros(len(head)), o[each] + 1])
    return index, shard.astype(np.int32), salt.astype(np.int32), np.concatenate([np.minimum(n, 1 << 30), np.full(len(each), 2)]).astype(np.int32)


def recurring_anchors(rows: DataFrame, k: int, window: int, seed: int, limit: int = 1 << 23) -> DataFrame:
    """(shard, hash) of the anchors whose hash occurs at least twice in the corpus, for every shard that has them. A task
    takes apart about limit bytes of texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, limit=limit):
                owner, found = _anchors(part, k, window, seed)
                index, *rest = told_apart(found, owner)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(found[index])), *map(pa.array, rest)], ["hash", "shard", "salt", "n"])

    anchors = rows.mapInArrow(run, "hash long, shard int, salt int, n int")
    total = F.sum("n").over(W.partitionBy("hash", "salt"))
    return anchors.withColumn("total", total).filter("total > 1 and shard >= 0").select("shard", "hash")
