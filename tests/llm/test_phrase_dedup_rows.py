"""Rows listed twice, several texts under one id and rows without an id, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from orrery.llm import phrase_dedup

RNG = np.random.default_rng(21)


def fresh(n):
    return " ".join(f"u{RNG.integers(1 << 40)}" for _ in range(n))


SHARED, OTHER = fresh(30), fresh(40)
TWICE = fresh(50)
ROWS = [
    (1, TWICE), (1, TWICE),
    (2, fresh(10) + " " + SHARED), (3, SHARED + " " + fresh(60)),
    (4, fresh(35)), (4, SHARED + " " + fresh(25)), (4, TWICE),
    (5, OTHER), (5, OTHER + " " + fresh(22)), (5, OTHER), (6, OTHER), (6, None), (6, "" + fresh(24)),
    (None, fresh(30) + " " + SHARED), (None, fresh(45)), (None, SHARED + " " + fresh(30)), (None, fresh(44) + " " + OTHER),
]


def brute(rows, lost):
    """rows in order of id and line; lost rows in the given order, before all others."""
    line = lambda t: int.from_bytes(hashlib.md5((t or "").encode()).digest()[:8], "big", signed=True)
    documents = [(None, t, 1) for t in lost] + [(*k, n) for k, n in sorted(Counter(r for r in rows if r[0] is not None).items(), key=lambda x: (x[0][0], line(x[0][1])))]
    seen, out = set(), Counter()
    for i, t, n in documents:
        words, gone = (t or "").split(), set()
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                gone.update(range(p, p + 20))
            seen.add(window)
        out[i, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)] += n
    return out


def got(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in phrase_dedup.remove_repeats(frame).collect())


@pytest.mark.parametrize("shard", [1 << 22, 300])
def test_repeated_ids_and_null_ids(spark, monkeypatch, shard):
    monkeypatch.setattr(phrase_dedup, "SHARD_BYTES", shard)
    assert got(spark, ROWS) == brute(ROWS, [t for i, t in ROWS if i is None])


def test_one_of_equal_rows_without_an_id_stays(spark):
    rows = [(None, TWICE), (None, TWICE), (None, TWICE), (7, TWICE)]
    assert got(spark, rows) == brute(rows, [TWICE] * 3)
