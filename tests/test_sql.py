"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)
QUERIES, SQL = entry.own_queries(), entry.own_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, database, name):
    ours, theirs = QUERIES[name](spark, FOLDER), database.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = sorted(str(tuple(row)) for row in ours.select(*theirs.columns).collect())
    assert rows == sorted(str(row) for row in theirs.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() == 196
