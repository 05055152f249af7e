"""Joins with a table of one row a key that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: A key is hot from one in HOT of all rows on, so there are at most HOT hot keys, whatever the size.
HOT = 1000


def _named(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def hot_keys(rows: DataFrame, key: str | list[str], total: int | None = None) -> list[Row]:
    """The key values, those with a null aside, that hold more than 1 / HOT of the rows: at most HOT of them. total is the
    number of rows, where it is known."""
    keys = _named(key)
    counted = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_rows"))
    return counted.filter(F.col("_rows") * HOT > (rows.count() if total is None else total)).select(*keys).collect()


def unique_join(rows: DataFrame, facts: DataFrame, key: str | list[str], how: str = "inner", counts: str | None = None, known: list[Row] | None = None) -> DataFrame:
    """rows joined with facts, which has one row a key: hot keys' facts are broadcast and their rows stay where they
    are, the others meet by a shuffle. how is inner or left; in a left join rows with a null key have null facts.

    counts names a column of facts with the rows of each key, where it is known, and known gives the hot keys of rows
    themselves, as of hot_keys: rows need not be counted then."""
    keys = _named(key)
    if known is not None:
        values = known
    elif counts is not None:
        total = facts.agg(F.sum(counts)).first()[0] or 0
        values = facts.filter(F.col(counts) * HOT > total).select(*keys).collect()
    else:
        values = hot_keys(rows, keys)
    hot = rows.sparkSession.createDataFrame(values, rows.select(*keys).schema) if values else None
    if hot is None:
        out, missing = rows.dropna(subset=keys).join(facts, keys, how), None
    else:
        few = F.broadcast(facts.join(F.broadcast(hot), keys, "left_semi"))
        rest = rows.dropna(subset=keys).join(F.broadcast(hot), keys, "left_anti").join(facts, keys, how)
        out = rows.join(few, keys, "inner").unionByName(rest)
        missing = rows.join(F.broadcast(hot), keys, "left_semi").join(few, keys, "left_anti")
    if how == "left":
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema.fields if f.name not in keys]
        some_null = F.lit(False)
        for k in keys:
            some_null = some_null | F.col(k).isNull()
        null_keys = rows.filter(some_null)
        missing = null_keys if missing is None else missing.unionByName(null_keys)
        out = out.unionByName(missing.select("*", *none))
    return out
