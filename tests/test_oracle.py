"""Every registered query against its SQL in DuckDB, column types included."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
# DuckDB's type -> Spark's
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def test_every_query_has_sql():
    assert set(contract.own_queries()) == set(contract.own_sql())


@pytest.mark.parametrize("name", list(contract.own_queries()))
def test_query_equals_sql(spark, db, name):
    df = contract.queries()[name](spark, FOLDER)
    expected = db.sql(contract.oracle_sql()[name])
    assert dict(df.dtypes) == {
        c: TYPES[str(t)] for c, t in zip(expected.columns, expected.types)
    }
    columns = sorted(df.columns)
    got = df.select(columns).collect()
    want = expected.select(*columns).fetchall()
    assert len(got) > 0

    assert Counter(map(tuple, got)) == Counter(want)


def test_entry(spark):
    assert contract.entry(spark).count() == 20
