"""Every query with SQL gives what the SQL gives."""

import duckdb
import pytest

from tickloom.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    cell = lambda v: (0, 0) if v is None or v != v else (1, v) if isinstance(v, str) else (2, float(v))
    key = lambda d: sorted(tuple(map(cell, r)) for r in d[cols].itertuples(index=False))
    assert key(a) == key(b)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, db, name):
    same(queries.QUERIES[name](spark, sf).toPandas(), db.execute(queries.ORACLE_SQL[name]).df())
