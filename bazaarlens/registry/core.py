"""Registration of queries, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.columns import half_even
from bazaarlens.functions.storage import materialise
from bazaarlens.operators.base import feature_input, order_items_wide
from bazaarlens.operators.cleaning import clean_items, clean_orders
from bazaarlens.operators.features import features_from_tables
from bazaarlens.registry.views import with_views
from bazaarlens.sources.tables import CommerceTables
from bazaarlens.sources.tpch import tables_from_tpch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Source:
    """The base datasets of one data folder, built on demand from the given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    @cached_property
    def tables(self) -> CommerceTables:
        return tables_from_tpch(self.spark, self.folder)

    def items(self, *columns: str) -> DataFrame:
        return order_items_wide(self.tables, columns) if columns else order_items_wide(self.tables)

    @cached_property
    def raw(self) -> DataFrame:
        return feature_input(self.tables)

    @cached_property
    def clean(self) -> DataFrame:
        return clean_items(self.tables)

    @cached_property
    def clean_orders(self) -> DataFrame:
        return clean_orders(self.tables)

    @cached_property
    def features(self) -> DataFrame:
        return features_from_tables(self.tables)

    @cached_property
    def stored_features(self) -> DataFrame:
        """The feature table written once, for operators that read it several times."""
        return materialise(self.features, "features")


def settled(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round the fractional columns: sums of doubles differ in their last bits with the order of the rows."""
    return df.select(
        *[half_even(F.col(c), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def register(name: str, run: Callable[[Source], DataFrame], sql: str | None = None) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return run(Source(spark, folder))

    query.__name__ = name
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = with_views(sql)
