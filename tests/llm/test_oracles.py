import duckdb
import pytest

from tributary.llm import queries

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same_rows(spark, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, small).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
