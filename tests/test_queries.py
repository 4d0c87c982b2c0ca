"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from arborframe.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    return c


def plain(row):
    return repr(tuple(float(v) if type(v).__name__ == "Decimal" else v for v in row))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    want = con.sql(ORACLES[name])
    columns = want.columns
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert sorted(map(plain, got)) == sorted(plain(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
