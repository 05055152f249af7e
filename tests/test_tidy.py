"""What steps that are over leave behind goes while the application runs."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from orrery.plans import fixpoint


def test_shuffle_files_of_earlier_tables_go(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "TIDY_S", 0, raising=False)
    folders = [Path(str(f)) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for f in folders for p in f.rglob("shuffle_*.data")}
    before = files()
    first = fixpoint.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "first")
    own = files() - before
    assert own
    fixpoint.written(first.filter("k > 3"), "second")
    until = time.monotonic() + 20
    while own & files() and time.monotonic() < until:
        time.sleep(0.2)
    assert not own & files()
    assert first.count() == 7
