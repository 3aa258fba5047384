"""Every relational query against the same in SQL on another engine, on the smallest tables."""

from pathlib import Path

import pytest

from tessera.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def rows(df, columns):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, str(DATA)).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
