"""Words before a widely shared passage that a few documents share as well, against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from orrery.llm import suffix_dedup


def covered(texts, n=50):
    seen, want = defaultdict(list), defaultdict(set)
    for i, t in enumerate(texts):
        words = t.split()
        for p in range(len(words) - n + 1):
            seen[tuple(words[p : p + n])].append((i, p))
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                want[i].update(range(p, p + n))
    return want


def found(spark, texts):
    got = defaultdict(set)
    for r in suffix_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r.doc_id].update(range(r.start, r.stop))
    return got


def test_head_variants_before_a_hot_body(spark):
    rng = np.random.default_rng(11)
    fresh = lambda n: " ".join(f"u{rng.integers(1 << 40)}" for _ in range(n))
    texts = []
    for _ in range(6):
        body, heads = fresh(120), [fresh(30) for _ in range(5)]
        texts += [f"{fresh(20)} {heads[i % 5]} {body} {fresh(15)}" for i in range(20)]
    assert found(spark, texts) == covered(texts)


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_rows_without_an_id_and_of_one_id(spark, partitions):
    """Different texts of one id, or without an id, are documents of their own, however few suffixes a partition has."""
    rng = np.random.default_rng(12)
    fresh = lambda n: " ".join(f"u{rng.integers(1 << 40)}" for _ in range(n))
    a, b, c = fresh(60), fresh(60), fresh(60)
    rows = [(None, f"{a} {fresh(9)}"), (None, f"{fresh(60)} {b}"), (4, f"{a} {c}"), (4, f"{fresh(7)} {b}"), (5, f"x {c}"), (6, fresh(70)), (7, b), (7, b), (None, None), (8, "")]
    rows += [(None, c), (None, c)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame([(i, t, "line", 3) for i, t in rows], "doc_id long, text string, line string, shard int")
        got = sorted(((r.doc_id, r.start, r.stop, r.partners) for r in suffix_dedup.repeated_passages(frame).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    spans = sorted(((d, s, e) for d, s, e, _ in got), key=str)
    assert spans == sorted([(None, 0, 60), (None, 60, 120), (4, 0, 120), (4, 7, 67), (5, 1, 61), (7, 0, 60), (None, 0, 60)], key=str)
    with_ = {(d, s, e): set(p) for d, s, e, p in got if d is not None}
    assert with_[4, 0, 120] <= {None, 5} and with_[5, 1, 61] <= {None, 4} and 7 in with_[7, 0, 60]


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_two_suffixes_that_are_no_match(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        tail = " ".join(f"t{i}" for i in range(49))
        assert suffix_dedup.repeated_passages(spark.createDataFrame([(0, f"xa {tail}"), (1, f"xb {tail}")], "doc_id long, text string")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
