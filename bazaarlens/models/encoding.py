"""Category codes as a stored table, for inputs with more values than a model's own indexer should hold.

The codes are those of :func:`bazaarlens.models.prep.category_codes`: 0, 1, ... by sorted value, missing values filled. They
are ranked without a sort in one task and stay a table: learned, stored and looked up by Spark jobs, never on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.ordered import running_totals
from bazaarlens.functions.storage import materialise

CODES = "category_codes"
SCHEMA = "column_name string, value string, code long"
#: The code of a value that was not seen in training.
UNSEEN = -1


def category_table(train: DataFrame, column: str, fill: str | None, buckets: int | None = None) -> DataFrame:
    """``column_name, value, code`` of every value of ``column``; ``buckets``: ranges of values to rank in, else by need.

    A column without any value, and with no ``fill``, has no codes.
    """
    filled = F.coalesce(F.col(column).cast("string"), F.lit(fill).cast("string"))
    values = train.select(filled.alias("value")).dropna().distinct().withColumn("one", F.lit(1))
    values = materialise(values, "categories")
    n = values.count()
    # cum_one counts the values from this one to the last
    ranked = running_totals(values, "value", ["one"], buckets)
    return ranked.select(F.lit(column).alias("column_name"), "value", (F.lit(n) - F.col("cum_one")).cast("long").alias("code"))


def category_tables(train: DataFrame, fills: Mapping[str, str | None]) -> DataFrame:
    """The codes of several columns, given what fills each."""
    return reduce(DataFrame.unionByName, [category_table(train, c, fill) for c, fill in fills.items()])


def encode(df: DataFrame, codes: DataFrame, fills: Mapping[str, str | None]) -> DataFrame:
    """``df`` with each column of ``fills`` replaced by its code (a double): missing values by the code of what fills them,
    values that are not in ``codes`` by UNSEEN.

    Each column is one join with its part of the table, broadcast only if Spark finds it small; a value that many rows
    share is split by the adaptive skew join, as the table has it once.
    """
    order = df.columns
    for column, fill in fills.items():
        part = codes.filter(F.col("column_name") == column).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        keyed = df.withColumn("_key", F.coalesce(F.col(column).cast("string"), F.lit(fill).cast("string")))
        joined = keyed.join(part, F.col("_key") == F.col("_value"), "left")
        code = F.coalesce("_code", F.lit(UNSEEN)).cast("double")
        df = joined.withColumn(column, code).select(*order)
    return df


def write_codes(codes: DataFrame, folder: str) -> None:
    """Store the codes beside the model."""
    codes.write.mode("overwrite").parquet(f"{folder}/{CODES}")


def read_codes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{folder}/{CODES}")
