"""Checks of the declared contract: row counts, keys, references, mandatory columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.sources.catalog import CATALOG
from bazaarlens.sources.tables import CommerceTables


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: CommerceTables) -> DataFrame:
    """``table_name, row_count`` for every loaded table. Parquet answers it from file footers."""
    return _stacked(
        [
            df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.present().items()
        ]
    )


def duplicate_keys(tables: CommerceTables, table: str) -> DataFrame:
    """Every declared key of ``table`` that more than one row carries, with its number of rows."""
    df = getattr(tables, table)
    return df.groupBy(*CATALOG[table].key).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def duplicate_key_counts(tables: CommerceTables) -> DataFrame:
    """``table_name, duplicate_keys, surplus_rows`` for every table with a declared key."""
    return _stacked(
        [
            duplicate_keys(tables, name)
            .agg(
                F.count("*").alias("duplicate_keys"),
                F.coalesce(F.sum(F.col("row_count") - 1), F.lit(0)).alias("surplus_rows"),
            )
            .select(F.lit(name).alias("table_name"), "duplicate_keys", "surplus_rows")
            for name in tables.present()
            if CATALOG[name].key
        ]
    )


def orphans(tables: CommerceTables, table: str, parent: str) -> DataFrame:
    """Rows of ``table`` whose reference to ``parent`` is set but finds no row."""
    reference = next(r for r in CATALOG[table].references if r.parent == parent)
    key = list(reference.columns)
    child = getattr(tables, table).dropna(subset=key)
    return child.join(getattr(tables, parent).select(*key), key, "left_anti")


def orphan_counts(tables: CommerceTables) -> DataFrame:
    """``table_name, parent_table, orphan_rows, status`` for every declared reference of the loaded tables.

    Children are counted per key before the join, so a key that half of the rows share costs one row. A reference to a
    table that is not loaded, or by a column that is not there, has no count and the status ``absent``.
    """
    loaded = tables.present()
    parts = []
    for name, df in loaded.items():
        for reference in CATALOG[name].references:
            key = list(reference.columns)
            parent = loaded.get(reference.parent)
            if parent is None or set(key) - set(df.columns) or set(key) - set(parent.columns):
                parts.append(_absent(df, table_name=name, parent_table=reference.parent, orphan_rows=None))
                continue
            per_key = df.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("n"))
            parts.append(
                per_key.join(parent.select(*key), key, "left_anti")
                .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"))
                .select(
                    F.lit(name).alias("table_name"),
                    F.lit(reference.parent).alias("parent_table"),
                    "orphan_rows",
                    F.lit("checked").alias("status"),
                )
            )
    return _stacked(parts)


def missing_mandatory(tables: CommerceTables) -> DataFrame:
    """``table_name, column_name, null_count, status`` for every mandatory column; one scan per table.

    A column that is not there has no count and the status ``absent``.
    """
    parts = []
    for name, df in tables.present().items():
        there = [c for c in CATALOG[name].mandatory if c in df.columns]
        if there:
            parts.append(
                _null_counts(df, there).select(
                    F.lit(name).alias("table_name"), "column_name", "null_count", F.lit("checked").alias("status")
                )
            )
        parts += [
            _absent(df, table_name=name, column_name=c, null_count=None)
            for c in CATALOG[name].mandatory
            if c not in df.columns
        ]
    return _stacked(parts)


def _absent(df: DataFrame, **values: str | None) -> DataFrame:
    columns = [F.lit(v).cast("string" if v else "long").alias(k) for k, v in values.items()]
    return df.sparkSession.range(1).select(*columns, F.lit("absent").alias("status"))


def _null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "null_count"
    )


def missing_values(df: DataFrame) -> DataFrame:
    """``column_name, null_count`` of the columns that hold nulls."""
    return _null_counts(df, df.columns).filter("null_count > 0")
