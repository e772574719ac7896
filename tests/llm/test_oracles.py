"""Queries that SQL can express against their DuckDB twins over the whole tables."""

import os

import duckdb
import pytest

from tarnwood.llm import entries
from tests.test_queries import rows_of


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_query_equals_its_twin(spark, sf, duck, name):
    got = entries.QUERIES[name](spark, sf)
    want = duck.execute(entries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())
