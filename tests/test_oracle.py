"""Every registered query against its SQL, on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from workload.oracle import SQL
from workload.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value)


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(row[i]) for i in order) for row in data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    ours = _rows(df.columns, df.collect())
    cursor = con.execute(entry_module.oracle_sql()[name])
    theirs = _rows([c[0] for c in cursor.description], cursor.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
