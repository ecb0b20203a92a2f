"""Every registered query against its oracle SQL on the smallest sample tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, _rows

from .conftest import SF

QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SF)
    got = frame.collect()
    if name not in ORACLE:
        assert got
        return
    cursor = db.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert _rows(got, frame.columns) == _rows(cursor.fetchall(), names)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["shard_key", "story_id", "text"]
