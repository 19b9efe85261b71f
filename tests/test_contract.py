"""Every registered query against its SQL on the smallest data."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as contract
from check import KINDS, TABLES, rows_of

SF_DIR = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def test_entry(spark):
    assert contract.entry(spark).count() == 2


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, db, name):
    df = contract.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = db.sql(sql)
    assert dict(df.dtypes) == {c: KINDS[str(t)] for c, t in zip(result.columns, result.types)}
    assert rows_of(got, df.columns) == rows_of(result.fetchall(), result.columns)
