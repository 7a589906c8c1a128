"""Wide item rows stored for the dashboard: one folder a month, bucketed by order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MONTH, ORDER = "month", "order_id"


def store_items(items: DataFrame, table: str, folder: str, buckets: int) -> DataFrame:
    """Store item rows (with ``month`` and ``order_id``) as ``table`` below ``folder``, replacing what was there.

    A choice of months reads the folders of these months alone, and what joins or groups by order finds its rows in place,
    without an exchange. Rows are dealt by order first, as the buckets are, so a bucket has one file a month; orders are a
    key of many values, so a month with most of the rows is still spread over all buckets. Choose the buckets so that one
    of them, over all months, is a task's work. Items without a purchase time stand in a folder of their own.
    """
    writer = items.repartition(buckets, ORDER).sortWithinPartitions(MONTH, ORDER).write.mode("overwrite").format("parquet")
    writer.option("path", folder).partitionBy(MONTH).bucketBy(buckets, ORDER).sortBy(ORDER).saveAsTable(table)
    return stored_items(items.sparkSession, table)


def stored_items(spark: SparkSession, table: str) -> DataFrame:
    """The rows that :func:`store_items` stored."""
    return spark.table(table)


def register_items(spark: SparkSession, table: str, folder: str, buckets: int) -> DataFrame:
    """Bring a stored folder into the catalog of another session, for catalogs that end with their session."""
    columns = spark.read.option("basePath", folder).parquet(folder).drop(MONTH).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    location = folder.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {table} ({fields}, {MONTH} string) USING parquet PARTITIONED BY ({MONTH}) "
        f"CLUSTERED BY ({ORDER}) SORTED BY ({ORDER}) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    spark.catalog.recoverPartitions(table)
    return stored_items(spark, table)
