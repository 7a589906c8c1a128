"""Run registered queries next to their SQL in DuckDB and compare names, types and values exactly.

Usage: python tests/oracle.py [folder] [name part ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bazaarlens.registry import ORACLE, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem".split()
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
    "BOOLEAN": "boolean",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _sortable(row):
    return tuple((value is None, str(type(value)), value if value is not None else 0) for value in row)


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def difference(spark, connection, folder: str, name: str) -> str | None:
    """None when both engines agree, else what differs."""
    df = QUERIES[name](spark, folder)
    names = sorted(df.columns)
    mine = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=_sortable)
    relation = connection.sql(ORACLE[name])
    if sorted(relation.columns) != names:
        return f"columns {names} / {sorted(relation.columns)}"
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    for column, kind in df.dtypes:
        if TYPES.get(kinds[column], kinds[column]) != kind:
            return f"type of {column}: {kind} / {kinds[column]}"
    order = [relation.columns.index(c) for c in names]
    theirs = sorted((tuple(_plain(r[i]) for i in order) for r in relation.fetchall()), key=_sortable)
    if len(mine) != len(theirs):
        return f"{len(mine)} / {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(wrong)} of {len(mine)} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    from conftest import new_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = [n for n in ORACLE if not sys.argv[2:] or any(part in n for part in sys.argv[2:])]
    spark, connection = new_session(), connect(folder)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            found = difference(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")


if __name__ == "__main__":
    main()
