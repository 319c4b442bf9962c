"""Every registered query against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from cardwarden.plans.oracle import ORACLE
from cardwarden.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=str)


def test_registry_is_consistent():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    names, sql = set(QUERIES), set(ORACLE)
    # What a model gives is no matter of SQL: tests/test_model.py walks its trees.
    assert names - sql == {"gbt_scores", "gbt_importances", "gbt_stream_scores"} and sql <= names


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert normal(df.columns, df.collect()) == normal(names, result.fetchall())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["first", "last", "total", "avg_txn_amt", "ntxn", "ftxn"] and df.count() > 0
