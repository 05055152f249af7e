"""Every query of the catalog against its SQL at the smallest scale."""

import duckdb
import pytest

from orrery.plans import analyses, catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


QUERIES, ORACLES = catalog.QUERIES | analyses.QUERIES, catalog.ORACLES | analyses.ORACLES


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(str(r[columns.index(c)]) for c in order) for r in result.fetchall()))
    assert sorted(tuple(str(r[c]) for c in order) for r in df.collect()) == want
