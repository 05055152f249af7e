"""What substring dedup shuffles: texts once, hashes in place of phrases."""

import numpy as np

from orrery.llm import phrase_dedup

RNG = np.random.default_rng(5)


def words(n):
    return [RNG.bytes(300).hex() for _ in range(n)]


def shuffled(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_phrases_are_counted_without_their_words(spark):
    rows = [(i, " ".join(words(200))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = shuffled(spark)
    assert [r.n_removed for r in phrase_dedup.remove_repeats(docs).collect()] == [0] * 8
    assert 0 < shuffled(spark) - before < 1.2 * sum(len(t) for _, t in rows)


def test_phrases_of_one_hash_are_told_apart_by_their_words():
    """An automaton of two phrases that share all but one word finds both, and nothing else."""
    automaton = phrase_dedup.phrase_automaton(np.array([[0, 1, 2, 3], [0, 1, 2, 300]], np.int32), 301)
    text, places = phrase_dedup.coded(np.array([5, 0, 1, 2, 3, 0, 1, 2, 300, 0, 1, 2, 4]), 301)
    assert sorted((end + 1) // places - 4 for end, _ in automaton.iter(text)) == [1, 5]
    assert phrase_dedup.phrase_automaton(np.zeros((0, 4), np.int32), 301) is None
