"""Rows without a doc_id, and rows that share one, in the pipeline's near dedup and decontamination."""

import numpy as np

import corpus_pipeline

RNG = np.random.default_rng(31)


def fresh(n):
    return " ".join(f"u{RNG.integers(1 << 40)}" for _ in range(n))


def kept(spark, stage, rows, sf_dir=""):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text) for r in stage(spark, frame, sf_dir).collect()), key=str)


def test_near_copies_without_an_id_go(spark):
    base, other, copy = fresh(200), fresh(200), fresh(80)
    first, second = (other + " " + fresh(2) for _ in range(2))
    rows = [(3, base), (None, base + " " + fresh(2)), (None, first), (None, second), (None, copy), (None, copy), (None, fresh(50)), (9, fresh(50)), (None, None)]
    got = kept(spark, corpus_pipeline.drop_near_copies, rows)
    assert sum(r in got for r in [(None, first), (None, second)]) == 1
    rest = [r for r in got if r[1] not in (first, second)]
    assert rest == sorted([rows[0], rows[4], *rows[6:]], key=str)


def test_leaks_go_by_row(spark, tmp_path):
    item = fresh(14)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, fresh(40)), (None, fresh(20) + " " + item), (None, fresh(30)), (2, item + " " + fresh(20)), (2, fresh(30)), (None, None)]
    assert kept(spark, corpus_pipeline.drop_benchmark_leaks, rows, str(tmp_path)) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
