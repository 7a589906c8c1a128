"""The SQL of the registered queries on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from bazaarlens.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for table in "documents pages benchmark labels conversations".split():
        found.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return found


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, connection, name):
    mine = QUERIES[name](spark, FOLDER)
    names = sorted(mine.columns)
    theirs = connection.sql(ORACLE[name])
    assert sorted(theirs.columns) == names
    order = [theirs.columns.index(c) for c in names]
    want = sorted((tuple(r[i] for i in order) for r in theirs.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in mine.collect()), key=repr) == want
