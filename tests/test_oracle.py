"""Every query with SQL gives the same rows as DuckDB; the others run and keep their rules."""

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return oracle.connect(FOLDER)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    assert oracle.difference(df, db, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_runs(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_sql_has_queries():
    assert set(SQL) <= set(entry.queries())
