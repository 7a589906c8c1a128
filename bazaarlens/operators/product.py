"""Category analytics over ``order_items_wide`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.columns import mean_of
from bazaarlens.operators.sales import largest, revenue_of, smallest


def category_performance(items: DataFrame) -> DataFrame:
    """Revenue, distinct orders and mean review score (weighted by item) per category."""
    return (
        items.dropna(subset=["category"])
        .groupBy("category")
        .agg(
            revenue_of().alias("revenue"),
            F.countDistinct("order_id").alias("orders"),
            mean_of(F.sum("review_score"), F.count("review_score")).alias("avg_review"),
        )
    )


def category_revenue(items: DataFrame) -> DataFrame:
    return items.dropna(subset=["category"]).groupBy("category").agg(revenue_of().alias("revenue"))


def top_categories(items: DataFrame, by: str = "revenue", limit: int = 15) -> DataFrame:
    """Best categories by ``revenue`` or ``orders``, with all their measures."""
    return largest(category_performance(items), by, "category", limit)


def top_category_revenue(items: DataFrame, limit: int = 10) -> DataFrame:
    return largest(category_revenue(items), "revenue", "category", limit)


def bottom_category_revenue(items: DataFrame, limit: int = 5) -> DataFrame:
    return smallest(category_revenue(items), "revenue", "category", limit)


def ranked_categories(items: DataFrame, limit: int = 10) -> DataFrame:
    """The top categories by revenue with their rank. Ranks are given to the ``limit`` rows that are left."""
    rank = F.row_number().over(Window.orderBy(F.col("revenue").desc(), "category"))
    return top_category_revenue(items, limit).withColumn("rank", rank)


def best_rated_categories(items: DataFrame, min_orders: int = 50, limit: int = 20) -> DataFrame:
    """Highest mean review among the categories with enough orders."""
    rated = category_performance(items).filter(
        (F.col("orders") >= min_orders) & F.col("avg_review").isNotNull()
    )
    return largest(rated, "avg_review", "category", limit)
