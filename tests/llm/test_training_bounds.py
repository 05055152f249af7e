"""The toxicity classifier's training texts stay inside their bounds on the driver, in number and in bytes."""

import numpy as np

from orrery.llm import toxicity


def test_sizes_that_fit_one_after_the_other():
    assert toxicity._within([5, 9, 3, 2, 4], 10) == [0, 2, 3]
    assert toxicity._within([], 3) == [] and toxicity._within([7], 3) == []


def test_a_byte_bound_leaves_out_whole_texts(spark):
    rng = np.random.default_rng(1)
    rows = [(i if i else None, " ".join(rng.choice(["some", "plain", "words"], 20)) + (" vilest" if i % 3 == 0 else ""), "en", int(i % 3 == 0)) for i in range(200)]
    rows += [(900, "long " * 100_000, "en", 1), (3, "another text", "en", 0), (901, None, "en", 1), (902, "no label", "en", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(5)
    sample = toxicity.training_sample(labelled, max_bytes=20_000).collect()
    sizes = [len(r.text) for r in sample]
    assert 100 < len(sizes) < 201 and sum(sizes) <= 20_000 and sorted(r.place for r in sample) == list(range(len(sample)))
    assert {r.text for r in sample} <= {t for _, t, _, y in rows if t and y is not None}
    assert toxicity.training_sample(labelled, max_train=7).count() == 7
    model = toxicity.train(labelled, visits=4000, max_bytes=20_000)
    scored = toxicity.score_texts(labelled.filter("doc_id < 900 and toxic is not null and text <> 'another text'"), model).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in scored]) > 0.9
    assert toxicity.train(labelled, max_bytes=0).base < 0 and toxicity.train(labelled.filter("false")).base < 0
