"""Every registered query against its SQL, over whole tables at the smallest scale."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as registered

TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for name in ("events", "nation"):
        connection.execute(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    return connection


def plain(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(row[i]) for i in order) for row in found)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql().keys() & registered._QUERIES.keys()))
def test_query_equals_sql(spark, database, name):
    frame = registered.queries()[name](spark, str(TABLES))
    answer = database.execute(registered.oracle_sql()[name])
    names = [column[0] for column in answer.description]
    assert sorted(names) == sorted(frame.columns)
    assert plain(frame.columns, frame.collect()) == plain(names, answer.fetchall())


def test_every_query_has_sql():
    assert set(registered._QUERIES) <= set(registered.oracle_sql())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
