"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, engine, name):
    found = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = [tuple(row[c] for c in columns) for row in found.collect()]
    assert rows
    if name in entry_points.oracle_sql():
        expected = engine.sql(entry_points.oracle_sql()[name])
        assert sorted(expected.columns) == columns
        places = [expected.columns.index(c) for c in columns]
        assert ordered(rows) == ordered(tuple(row[i] for i in places) for row in expected.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
