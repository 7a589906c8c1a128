"""Load the source tables from CSV or Parquet, store them, and register them as views."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.sources.catalog import CATALOG, TableSpec
from bazaarlens.sources.quoted_csv import read_quoted_csv

log = logging.getLogger(__name__)

ORDER_KEYED = ("orders", "order_items", "payments", "reviews")


class CommerceTables:
    """The source tables as attributes, named as in the catalog.

    A table is given as a DataFrame or as a function that builds it on first use; one that was not loaded is ``None``.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame] | None):
        unknown = set(tables) - set(CATALOG)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._tables = {name: tables.get(name) for name in CATALOG}

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in CATALOG:
            raise AttributeError(name)
        table = self._tables[name]
        if callable(table):
            table = self._tables[name] = table()
        return table

    def present(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in CATALOG if getattr(self, name) is not None}

    def replaced(self, **tables: DataFrame) -> CommerceTables:
        """The same tables but for the given ones."""
        return CommerceTables(**(self._tables | tables))

    def register_views(self) -> None:
        """Make every loaded table usable by name in ``spark.sql``."""
        for name, df in self.present().items():
            df.createOrReplaceTempView(name)


def _or_missing(name: str, read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("%s: no such path, skipped", name)
        return None


def _typed(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Cast the text columns of a CSV to the declared types; text that does not parse becomes null."""
    wanted = spec.schema
    return raw.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields]
    )


def _csv_text(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """All columns of the files as text, under the names in their headers, which must agree from file to file."""
    options = {
        "header": True,
        # A doubled quote inside a quoted field stands for a quote.
        "escape": '"',
    }
    found = spark.read.options(**options).csv(path).columns
    absent = sorted(set(spec.columns) - set(found))
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    if spec.multi_line:  # only free-text comments hold line breaks
        return read_quoted_csv(spark, path, found)
    text = ", ".join(f"`{c}` STRING" for c in found)
    return spark.read.schema(text).options(**options, enforceSchema=False).csv(path)


def read_csv_table(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """One CSV file, or a folder or glob of them: its declared columns, found by name. Others are left out."""
    return _typed(_csv_text(spark, path, spec), spec)


def unparsed_values(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """``column_name, unparsed``: how many values of each column are set but do not parse as the declared type."""
    raw = _csv_text(spark, path, spec)
    faults = [
        F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name)
        for f in spec.schema.fields
    ]
    return raw.agg(*faults).unpivot([], list(spec.columns), "column_name", "unparsed")


def read_csv_tables(
    spark: SparkSession, folder: str, files: Mapping[str, str] | None = None
) -> CommerceTables:
    """Read all CSV tables below ``folder``; ``files`` overrides the file name (or glob) of single tables."""
    names = {name: spec.csv_file for name, spec in CATALOG.items()} | dict(files or {})
    return CommerceTables(
        **{
            name: _or_missing(name, lambda n=name: read_csv_table(spark, f"{folder}/{names[n]}", CATALOG[n]))
            for name in CATALOG
        }
    )


def read_tables(spark: SparkSession, folder: str) -> CommerceTables:
    """Read the Parquet tables written by :func:`write_tables`."""
    return CommerceTables(
        **{
            name: _or_missing(
                name, lambda n=name: spark.read.schema(CATALOG[n].schema).parquet(f"{folder}/{n}")
            )
            for name in CATALOG
        }
    )


def write_tables(tables: CommerceTables, folder: str) -> None:
    """Store every loaded table as Parquet, replacing what was there."""
    for name, df in tables.present().items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def save_bucketed_tables(tables: CommerceTables, database: str, folder: str, buckets: int) -> None:
    """Store the tables in the session catalog, with those keyed by order bucketed on ``order_id``.

    Orders, items, payments and reviews then join and pre-aggregate by order without a shuffle.
    """
    for name, df in tables.present().items():
        writer = df.write.mode("overwrite").format("parquet").option("path", f"{folder}/{name}")
        if name in ORDER_KEYED:
            writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
        writer.saveAsTable(f"{database}.{name}")


def load_saved_tables(spark: SparkSession, database: str) -> CommerceTables:
    """Read the tables stored by :func:`save_bucketed_tables`."""
    return CommerceTables(
        **{
            name: spark.table(f"{database}.{name}")
            for name in CATALOG
            if spark.catalog.tableExists(f"{database}.{name}")
        }
    )
