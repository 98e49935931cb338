"""Every query with SQL gives the SQL's rows on the driver's small tables."""

import os

import duckdb
import pytest

from paceline.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


def shown(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    r = db.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert got == rows_of(r.fetchall(), list(r.columns))
    assert got


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
