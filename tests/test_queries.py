"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tributary.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 8) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    rows = normal(map(tuple, df.collect()), df.columns)
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows == normal(want.fetchall(), want.columns)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() == 2000
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
