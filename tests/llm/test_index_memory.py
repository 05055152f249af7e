"""What the positional index and the tables of words hold at once: pages of a row, flags instead of numbers a byte."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from orrery.llm import decontamination
from orrery.llm import kernels as K


def test_a_page_of_the_index_holds_one_segment(spark, monkeypatch):
    tables = []

    def written(df, name, *options):
        tables.append(made(df, name, *options))
        return tables[-1]

    made = decontamination.written
    monkeypatch.setattr(decontamination, "written", written)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60_000, 300_000)) for _ in range(8)] + [None, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, " ".join(texts[2].split()[5:17])), (8, "one")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.contamination(docs, items).collect()}
    assert got == {i: (len((t or "").split()), 12 if i == 2 else 1 if i == 10 else 0, ["7"] if i == 2 else ["8"] if i == 10 else []) for i, t in enumerate(texts)}
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in tables[0].inputFiles()]
    assert sum(m.num_rows for m in files) == 8
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.total_byte_size for g in groups) > 10 << 20
    assert max(g.num_rows for g in groups) <= 2
    assert max(g.total_byte_size for g in groups) < 6 << 20


def test_a_table_of_words_takes_a_few_bytes_a_byte_of_text():
    rng = np.random.default_rng(6)
    ends = np.cumsum(rng.integers(1, 12, 1 << 18))
    starts = np.concatenate([[0], ends[:-1]])
    data = rng.integers(97, 123, ends[-1]).astype(np.uint8)
    tracemalloc.start()
    try:
        K.binary_array(data, starts, ends)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Besides the words' own sizes and ends.
    assert most - 4 * ends.nbytes < 4 * len(data)


def test_words_are_those_of_their_bytes():
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 400).astype(np.uint8)
    cuts = np.sort(rng.choice(401, 60, replace=False))
    ordered = (cuts[::2], cuts[1::2])
    gapless = (cuts[:-1], cuts[1:])
    whole = (np.array([0]), np.array([400]))
    none = (cuts[:0], cuts[:0])
    empty = (np.array([3, 9, 9]), np.array([3, 9, 12]))
    overlapping = (np.array([0, 2, 1]), np.array([5, 4, 400]))
    turned = tuple(x[::-1] for x in ordered)
    for starts, ends in (ordered, gapless, whole, none, empty, overlapping, turned):
        assert K.binary_array(data, starts, ends).to_pylist() == [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert K.binary_array(data[:0], *none).to_pylist() == []
