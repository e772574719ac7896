"""Every registered query against its DuckDB twin."""

import math
import os

import duckdb
import pytest

from tarnwood import catalog_queries, graph_queries, merge_queries, read_queries, stream_queries  # noqa: F401  (registers its queries)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def duck_over(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_query(spark, larger_sf, name):
    got = catalog_queries.QUERIES[name](spark, larger_sf)
    rows = [tuple(r) for r in got.collect()]
    if name in catalog_queries.ORACLE_SQL:
        want = duck_over(larger_sf).execute(catalog_queries.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows_of(got.columns, rows) == rows_of(columns, want.fetchall())
