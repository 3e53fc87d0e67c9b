"""Every registered query against its SQL check, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return connection


def _plain(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def _rows(rows: list, order: list[int]) -> list:
    return sorted([_plain(row[i]) for i in order] for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name: str, spark, duck) -> None:
    result = QUERIES[name](spark, DATA)
    names = sorted(result.columns)
    found = _rows(result.collect(), [result.columns.index(n) for n in names])
    if name not in CHECKS:
        assert found
        return
    cursor = duck.execute(CHECKS[name])
    theirs = [column[0] for column in cursor.description]
    assert sorted(theirs) == names
    assert found == _rows(cursor.fetchall(), [theirs.index(n) for n in names])


def test_every_check_has_a_query() -> None:
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark) -> None:
    assert entry.entry(spark).columns == ["chatroom", "day_key", "messages", "senders"]
