"""Sales analytics over ``order_items_wide`` rows, filtered or not.

Rows without a group key drop out here, unlike in the stand-alone reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.columns import as_double, mean_of


def revenue_of(column: str = "item_value") -> Column:
    return as_double(F.sum(column))


def largest(df: DataFrame, measure: str, key: str, limit: int) -> DataFrame:
    """Top rows by ``measure``; equal values go to the smaller key first."""
    return df.orderBy(F.col(measure).desc(), key).limit(limit)


def smallest(df: DataFrame, measure: str, key: str, limit: int) -> DataFrame:
    return df.orderBy(F.col(measure).asc(), key).limit(limit)


def monthly_revenue(items: DataFrame) -> DataFrame:
    return items.dropna(subset=["month"]).groupBy("month").agg(revenue_of().alias("revenue")).orderBy("month")


def monthly_orders(items: DataFrame) -> DataFrame:
    return (
        items.dropna(subset=["month"])
        .groupBy("month")
        .agg(F.countDistinct("order_id").alias("orders"))
        .orderBy("month")
    )


def monthly_growth(items: DataFrame) -> DataFrame:
    """Revenue and orders per month with growth in percent over the previous month that has rows."""
    monthly = (
        items.dropna(subset=["month"])
        .groupBy("month")
        .agg(revenue_of().alias("revenue"), F.countDistinct("order_id").alias("orders"))
    )
    # One row per month is left here, so the single window partition stays tiny.
    previous = F.lag("revenue").over(Window.orderBy("month"))
    growth = (F.try_divide(F.col("revenue"), previous) - 1) * 100
    return monthly.withColumn("growth_pct", growth).orderBy("month")


def category_trend(items: DataFrame, limit: int = 8) -> DataFrame:
    """Monthly revenue of the categories with the highest total revenue.

    Items are aggregated once by month and category; the ranking and the result both come from that.
    """
    cells = (
        items.dropna(subset=["category"]).groupBy("month", "category").agg(F.sum("item_value").alias("revenue"))
    )
    totals = cells.groupBy("category").agg(F.sum("revenue").alias("total"))
    chosen = largest(totals, "total", "category", limit).select("category")
    return (
        cells.join(chosen, "category", "left_semi")
        .dropna(subset=["month"])
        .select("month", "category", as_double(F.col("revenue")).alias("revenue"))
        .orderBy("month", "category")
    )


def product_revenue(items: DataFrame) -> DataFrame:
    return items.dropna(subset=["product_id"]).groupBy("product_id").agg(revenue_of().alias("revenue"))


def top_products(items: DataFrame, limit: int = 15) -> DataFrame:
    return largest(product_revenue(items), "revenue", "product_id", limit)


def bottom_products(items: DataFrame, limit: int = 15) -> DataFrame:
    return smallest(product_revenue(items), "revenue", "product_id", limit)


def monthly_aov(items: DataFrame) -> DataFrame:
    """Mean order value per month: items are summed per order first."""
    return (
        items.dropna(subset=["month", "order_id"])
        .groupBy("month", "order_id")
        .agg(F.sum("item_value").alias("order_value"))
        .groupBy("month")
        .agg(mean_of(F.sum("order_value"), F.count("order_value")).alias("aov"))
        .orderBy("month")
    )


def payment_breakdown(items: DataFrame) -> DataFrame:
    """Orders and revenue per payment type.

    ``revenue`` counts only the first item of each order (lowest product, then highest price);
    ``order_revenue`` counts all of them.
    """
    first = F.struct("product_id", -F.col("price"), "freight_value")
    orders = items.groupBy("order_id").agg(
        F.min("payment_type").alias("payment_type"),
        F.min_by("item_value", first).alias("first_value"),
        F.sum("item_value").alias("order_value"),
    )
    return (
        orders.dropna(subset=["payment_type"])
        .groupBy("payment_type")
        .agg(
            F.count("order_id").alias("orders"),
            revenue_of("first_value").alias("revenue"),
            revenue_of("order_value").alias("order_revenue"),
        )
        .orderBy("payment_type")
    )


def payment_order_counts(items: DataFrame) -> DataFrame:
    """Distinct orders per payment type; an order has one primary payment."""
    return (
        items.dropna(subset=["payment_type"])
        .groupBy("payment_type")
        .agg(F.countDistinct("order_id").alias("orders"))
        .orderBy("payment_type")
    )
