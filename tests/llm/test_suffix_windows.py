"""Windows that no neighbour shares: compared where they may be equal only, and none is missed."""

from collections import defaultdict

import numpy as np
import pytest

from orrery.llm import suffix_dedup


def fresh(rng, n):
    return [f"u{rng.integers(1 << 40)}" for _ in range(n)]


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
    for r in suffix_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect():
        got[r.doc_id].update(range(r.start, r.stop))
    return got


def shuffled_rows(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_common_phrase_sends_no_windows_that_can_have_no_partner(spark):
    """Many texts share 30 words and nothing else; of a few, one shares more with one text before them, more with another after them."""
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(10):
        head, common, tail = fresh(rng, 40), fresh(rng, 30), fresh(rng, 40)
        texts += [" ".join(fresh(rng, 40) + common + fresh(rng, 40)) for _ in range(150)]
        texts += [" ".join(a + common + b) for a, b in ((head, tail), (head, fresh(rng, 40)), (fresh(rng, 40), tail))]
    before = shuffled_rows(spark)
    assert found(spark, texts) == covered(texts)
    assert shuffled_rows(spark) - before < 13 * len(texts)


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_mixed_stretches(spark, partitions):
    """Texts put together from few stretches, some with a word changed: runs of neighbours that share windows, of all lengths."""
    rng = np.random.default_rng(22)
    stretches = [fresh(rng, n) for n in (9, 14, 20, 27, 33, 41, 60) for _ in range(3)]
    texts = []
    for _ in range(120):
        words = sum((stretches[i] for i in rng.integers(0, len(stretches), rng.integers(2, 7))), [])
        for at in rng.integers(0, len(words), rng.integers(0, 3)):
            words[at] = f"v{rng.integers(3)}"
        texts.append(" ".join(words))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert found(spark, texts) == covered(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
