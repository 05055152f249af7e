"""What the pipeline's tasks hold and move: freed memory goes back, texts stay where they are."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from orrery.llm import toxicity

#: A task that frees 100 MB below something that stays, which malloc alone keeps.
TASK = """
from pathlib import Path
from orrery.llm import kernels as K

def held():
    return int(Path("/proc/self/status").read_text().split("VmRSS:")[1].split()[0]) / 1024

def task(batches):
    freed = [b"x" * 50_000 for _ in range(2000)]
    for batch in batches:
        yield batch * 50_000, held()

(last, most), = K.tidy(task)([b"y"])
print(most - held())
"""


def test_a_task_gives_its_memory_back():
    done = subprocess.run([sys.executable, "-c", TASK], cwd=Path(corpus_pipeline.__file__).parent, capture_output=True, text=True, check=True, timeout=120)
    assert float(done.stdout) > 80


@pytest.mark.parametrize("most", [corpus_pipeline.SENT_KEYS, 0])
def test_texts_stay_where_they_are_unless_many_rows_go(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(corpus_pipeline, "SENT_KEYS", most)
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, " ".join(f"w{j}" for j in range(i % 3 * 100, i % 3 * 100 + 12))) for i in range(30)] + [(None, None), (31, "w0"), (32, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage, expected in [
            (corpus_pipeline.drop_benchmark_leaks, [r for r in rows if not (r[0] is not None and r[0] % 3 == 0 and r[0] < 30)]),
            (corpus_pipeline.drop_near_copies, [*(r for r in rows if r[0] in (0, 1, 2)), *rows[-3:]]),
        ]:
            left = stage(spark, docs, str(tmp_path))
            plan = left._jdf.queryExecution().executedPlan().toString()
            assert ("Exchange hashpartitioning" in plan) == (most == 0)
            assert sorted(map(tuple, left.collect()), key=str) == sorted(expected, key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_scores_are_those_of_single_texts(spark):
    model = toxicity.Cnn(3)
    rng = np.random.default_rng(8)
    texts = [None, "", "?!", *(" ".join(f"v{k}" for k in rng.integers(0, 900, n)) for n in (1, 2, 40, 60_000, 90_000, 300_000, 7))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    want = {i: model.score(toxicity.word_rows(pa.array([t], pa.large_string()))[0]) for i, t in enumerate(texts)}
    assert got == want
