"""State and city analytics over ``order_items_wide`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import mean_of
from bazaarlens.operators.sales import largest, revenue_of


def state_performance(items: DataFrame) -> DataFrame:
    """Revenue, distinct orders and customers, mean delivery days and late share (both by item) per state.

    Rolled up order, customer, state: two distinct counts come out as plain counts, without the row expansion of
    two ``countDistinct``, and a state or customer with very many rows is spread by order.
    """
    orders = (
        items.dropna(subset=["state"])
        .groupBy("state", "customer_unique_id", "order_id")
        .agg(
            F.sum("item_value").alias("item_value"),
            F.sum("delivery_days").alias("days"),
            F.count("delivery_days").alias("dated"),
            F.sum("is_delayed").alias("late"),
            F.count("*").alias("items"),
        )
    )
    measures = ("item_value", "days", "dated", "late", "items")
    customers = orders.groupBy("state", "customer_unique_id").agg(
        F.count("order_id").alias("orders"), *[F.sum(m).alias(m) for m in measures]
    )
    return customers.groupBy("state").agg(
        revenue_of().alias("revenue"),
        F.sum("orders").alias("orders"),
        F.count("customer_unique_id").alias("customers"),
        mean_of(F.sum("days"), F.sum("dated")).alias("avg_delivery"),
        mean_of(F.sum("late"), F.sum("items")).alias("pct_delayed"),
    )


def state_ranking(items: DataFrame, by: str = "revenue") -> DataFrame:
    """All states, largest ``revenue``, ``orders``, ``avg_delivery`` or ``pct_delayed`` first."""
    return state_performance(items).orderBy(F.col(by).desc_nulls_last(), "state")


def top_states(items: DataFrame, limit: int = 10) -> DataFrame:
    """The report table: best states by revenue with delivery quality."""
    return largest(state_performance(items), "revenue", "state", limit).select(
        "state", "revenue", "orders", "avg_delivery", (F.col("pct_delayed") * 100).alias("pct_delayed")
    )


def top_state_revenue(items: DataFrame, limit: int = 5) -> DataFrame:
    states = items.dropna(subset=["state"]).groupBy("state").agg(revenue_of().alias("revenue"))
    return largest(states, "revenue", "state", limit)


def top_cities(items: DataFrame, limit: int = 20) -> DataFrame:
    """Best cities by revenue, labelled ``City Name (STATE)``."""
    cities = (
        items.dropna(subset=["state", "city"])
        .groupBy("state", "city")
        .agg(revenue_of().alias("revenue"), F.countDistinct("order_id").alias("orders"))
    )
    return (
        cities.orderBy(F.desc("revenue"), "state", "city")
        .limit(limit)
        .withColumn("label", F.concat(F.initcap("city"), F.lit(" ("), F.col("state"), F.lit(")")))
    )
