"""Driver loops over DataFrames. Every round's state is a table in the folder that all executors share, so lineage
stays short and a lost executor costs one round's work at most."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Paths of the tables that an application has written and not deleted, in order.
_tables: dict[str, dict[str, None]] = {}
_clearings: Counter[str] = Counter()
#: Seconds between two clearings of what the driver no longer uses.
TIDY_S = 10
_tidied: dict[str, float] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own, but only if driver and executors are one
    machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="orrery-")
    return _own[key]


def tidy(spark: SparkSession) -> None:
    """Plans, broadcasts, generated classes and shuffle files of steps that are over go. Spark drops them when the driver's
    JVM collects its garbage, which left alone it does once its heap has grown full."""
    key, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _tidied.setdefault(key, now) < TIDY_S:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _tidied[key] = time.monotonic()


def written(df: DataFrame, name: str, options: dict[str, int | str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and any executor can read it. Options
    are those of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, {})[path] = None
    df.write.options(**(options or {})).parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again."""
    return written(df, "state")


def latest(spark: SparkSession) -> str:
    """Where the table lies that was written last."""
    return next(reversed(_tables[spark.sparkContext.applicationId]))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table that is read no more."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    _tables[context.applicationId].pop(path, None)


def clear(spark: SparkSession) -> int:
    """Deletes all tables that this application has written for its steps, and gives their number. Results that are read
    from them must have been read or written elsewhere by then."""
    paths = list(_tables.get(spark.sparkContext.applicationId, {}))
    for path in paths:
        delete(spark, path)
    _clearings[spark.sparkContext.applicationId] += 1
    return len(paths)


def clearings(spark: SparkSession) -> int:
    """How often clear() ran: tables kept for later belong to one such time."""
    return _clearings[spark.sparkContext.applicationId]


def grow(seed: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: list[str]) -> DataFrame:
    """Semi-naive closure: each round's new rows feed the next, until none is new by its keys.

    step(delta, round) gives candidates with seed's columns; all rows ever new come back."""
    delta = saved(seed.dropDuplicates(keys))
    known, rounds = delta, 0
    while not delta.isEmpty():
        rounds += 1
        delta = saved(step(delta, rounds).select(*seed.columns).dropDuplicates(keys).join(known, keys, "left_anti"))
        known = saved(known.unionByName(delta)) if rounds % 8 == 0 else known.unionByName(delta)
    return known


def settle(state: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, value: str) -> DataFrame:
    """Repeats step on a (key, value) table until no value changes."""
    spark = state.sparkSession
    state = saved(state)
    place = latest(spark)
    while True:
        old = state.select(key, F.col(value).alias("_old"))
        after = saved(step(state).select(key, value).join(old, key).select(key, value, (~F.col(value).eqNullSafe(F.col("_old"))).alias("_moved")))
        state = after.select(key, value)
        # The round before is read no more.
        delete(spark, place)
        place = latest(spark)
        if after.filter("_moved").isEmpty():
            return state
