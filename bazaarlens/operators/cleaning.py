"""Cleaning rules for item rows, each usable on its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.columns import mean_of, not_below
from bazaarlens.operators.base import FEATURE_INPUT_COLUMNS, ORDER_TIMES, UNKNOWN, feature_input, order_facts
from bazaarlens.sources.tables import CommerceTables

LINE_KEY = ("order_id", "product_id", "seller_id")


def line_order() -> list[Column]:
    """Which of several equal lines counts as the first: highest price, then lowest freight."""
    return [F.col("price").desc(), F.col("freight_value").asc_nulls_last()]


def parse_timestamps(df: DataFrame, columns: Sequence[str] = ORDER_TIMES) -> DataFrame:
    """Read text as timestamps; text that is none becomes null. Typed columns pass unchanged."""
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in columns})


def drop_undated(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["order_purchase_timestamp"])


def drop_repeated_lines(
    df: DataFrame, key: Sequence[str] = LINE_KEY, order: Sequence[Column] | None = None
) -> DataFrame:
    """Keep the first row per ``key``.

    A row number with ``= 1`` is trimmed to one row per key in every map task before the shuffle, so a key with
    very many copies does not gather in one task.
    """
    first = Window.partitionBy(*key).orderBy(*(order or line_order()))
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def keep_priced(df: DataFrame) -> DataFrame:
    return df.filter(F.col("price") > 0)


def clip_freight(df: DataFrame) -> DataFrame:
    return df.withColumn("freight_value", not_below(F.col("freight_value"), 0))


def fill_category(df: DataFrame) -> DataFrame:
    return df.fillna(UNKNOWN, "category")


def fill_payment_type(df: DataFrame) -> DataFrame:
    return df.fillna(UNKNOWN, "payment_type")


def clean(df: DataFrame, key: Sequence[str] = LINE_KEY) -> DataFrame:
    """All rules in order. ``review_score`` keeps its nulls, which averages skip."""
    df = drop_undated(parse_timestamps(df))
    df = clip_freight(keep_priced(drop_repeated_lines(df, key)))
    return fill_payment_type(fill_category(df))


def _clean_lines(tables: CommerceTables) -> DataFrame:
    lines = tables.order_items.select("order_id", "product_id", "seller_id", "price", "freight_value")
    return clip_freight(keep_priced(drop_repeated_lines(lines)))


def clean_items(tables: CommerceTables, columns: Sequence[str] = FEATURE_INPUT_COLUMNS) -> DataFrame:
    """``clean(feature_input(tables))``, with the repeated lines dropped from the narrow item table first.

    Every other column depends on the order or the product, so the order of the two steps does not matter, and the
    wide rows are not shuffled by line. Only joins that ``columns`` need are made.
    """
    joined = feature_input(tables.replaced(order_items=_clean_lines(tables)), columns)
    filled = {c: UNKNOWN for c in ("category", "payment_type") if c in columns}
    return joined.fillna(filled) if filled else joined


def clean_orders(
    tables: CommerceTables, columns: Sequence[str] = ("customer_unique_id", "payment_type", "review_score")
) -> DataFrame:
    """The orders of :func:`clean_items`, one row each, without going through the items.

    The first of several equal lines is the one with the highest price, so an order keeps a line exactly when it has
    a priced one.
    """
    priced = keep_priced(tables.order_items).select("order_id")
    orders = (
        order_facts(tables, columns)
        .dropna(subset=["order_purchase_timestamp"])
        .join(priced, "order_id", "left_semi")
        .withColumnsRenamed({"state": "customer_state", "city": "customer_city"})
    )
    return fill_payment_type(orders) if "payment_type" in columns else orders


def cleaning_audit(df: DataFrame, key: Sequence[str] = LINE_KEY) -> DataFrame:
    """Rows in, rows dropped by each rule, rows out, and the dropped share in percent, as one row."""
    dated = F.col("order_purchase_timestamp").isNotNull()
    # Copies of a line collapse to one row with their number and the price of the first, in one aggregate.
    lines = (
        parse_timestamps(df)
        .groupBy(*key, dated.alias("dated"))
        .agg(F.count("*").alias("copies"), F.max("price").alias("price"))
    )
    counted = lines.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(F.when(F.col("dated"), F.col("copies"))), F.lit(0)).alias("dated"),
        F.count_if("dated").alias("lines"),
        F.count_if(F.col("dated") & (F.col("price") > 0)).alias("rows_out"),
    )
    return counted.select(
        "rows_in",
        (F.col("rows_in") - F.col("dated")).alias("dropped_undated"),
        (F.col("dated") - F.col("lines")).alias("dropped_repeated"),
        (F.col("lines") - F.col("rows_out")).alias("dropped_unpriced"),
        "rows_out",
        (mean_of(F.col("rows_in") - F.col("rows_out"), F.col("rows_in")) * 100).alias("dropped_pct"),
    )
