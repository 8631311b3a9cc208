"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.plans.registry import ORACLE, QUERIES
from tests.conftest import SF_DIR

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def _norm(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9)
    return bytes(value) if isinstance(value, (bytes, bytearray)) else value


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in result.collect()]
    if name not in ORACLE:
        assert rows
        return
    expected = duck.sql(ORACLE[name])
    columns = expected.columns
    assert sorted(result.columns) == sorted(columns)
    assert _rows(result.columns, rows) == _rows(columns, expected.fetchall())
