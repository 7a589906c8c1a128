"""One row per customer from clean item rows: spend, behaviour, delivery, payment, recency, churn label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import flag, floor_days, half_even, mean_of, not_below
from bazaarlens.operators.cleaning import clean_items, clean_orders
from bazaarlens.sources.tables import CommerceTables

CHURN_DAYS = 180
ROUNDING = 4

# Output columns in order.
FEATURE_COLUMNS = (
    "customer_unique_id",
    "total_spend",
    "total_products",
    "distinct_categories",
    "distinct_sellers",
    "num_orders",
    "avg_delivery_days",
    "avg_review_score",
    "pct_delayed",
    "weekend_purchase_ratio",
    "state",
    "city",
    "days_since_first_purchase",
    "days_since_last_purchase",
    "customer_lifetime_days",
    "preferred_payment_method",
    "avg_order_value",
    "avg_basket_size",
    "purchase_frequency",
    "avg_freight_ratio",
    "churn",
)
ROUNDED = (
    "total_spend",
    "avg_delivery_days",
    "avg_review_score",
    "pct_delayed",
    "weekend_purchase_ratio",
    "avg_order_value",
    "avg_basket_size",
    "purchase_frequency",
    "avg_freight_ratio",
)


def reference_date(items: DataFrame) -> DataFrame:
    """Midnight of the last purchase day, as one row."""
    last = F.max("order_purchase_timestamp")
    return items.agg(F.to_date(last).cast("timestamp_ntz").alias("reference_date"))


def item_level(items: DataFrame) -> DataFrame:
    """Spend, products, categories and sellers per customer.

    Items are summed by customer, category and seller first. Spark plans the two distinct counts over rows keyed by
    customer and value, so one customer with very many rows is spread over tasks before the counts come together.
    """
    sums = items.groupBy("customer_unique_id", "category", "seller_id").agg(
        F.sum(F.col("price") + F.col("freight_value")).alias("spend"),
        F.count("product_id").alias("products"),
        F.sum("freight_value").alias("freight"),
    )
    return sums.groupBy("customer_unique_id").agg(
        F.sum("spend").alias("spend"),
        F.sum("products").alias("total_products"),
        F.countDistinct("category").alias("distinct_categories"),
        F.countDistinct("seller_id").alias("distinct_sellers"),
        F.sum("freight").alias("freight"),
    )


def orders_of(items: DataFrame) -> DataFrame:
    """One row per order. All columns taken here are the same on every item of an order."""
    return items.groupBy("order_id", "customer_unique_id").agg(
        *[
            F.min(c).alias(c)
            for c in (
                "order_purchase_timestamp",
                "order_delivered_customer_date",
                "order_estimated_delivery_date",
                "review_score",
                "payment_type",
                "customer_state",
                "customer_city",
            )
        ]
    )


def order_level(orders: DataFrame) -> DataFrame:
    """Order count, purchase times, delivery, review, place and preferred payment per customer, from one row per order.

    Rolled up order, customer and payment type, customer: the most used payment type needs no window, and what one
    very active customer sends to a task is one row per payment type and map task.
    """
    purchased = F.col("order_purchase_timestamp")
    delivered = F.col("order_delivered_customer_date")
    days = floor_days(purchased, delivered)
    place = F.struct(purchased, "order_id", "customer_state", "customer_city")
    by_payment = (
        orders.groupBy("customer_unique_id", "payment_type")
        .agg(
            F.count("order_id").alias("orders"),
            F.min(purchased).alias("first_purchase"),
            F.max(purchased).alias("last_purchase"),
            F.sum(days).alias("days"),
            F.count(days).alias("dated"),
            F.sum("review_score").alias("score"),
            F.count("review_score").alias("scored"),
            F.sum(flag(delivered > F.col("order_estimated_delivery_date"))).alias("late"),
            F.sum(flag(F.weekday(purchased) >= 5)).alias("weekend"),
            F.min(place).alias("place"),
        )
    )
    # A missing payment type counts as an order but is never the preferred one.
    rank = F.struct(F.col("payment_type").isNull(), -F.col("orders"), F.col("payment_type"))
    return by_payment.groupBy("customer_unique_id").agg(
        F.sum("orders").alias("num_orders"),
        F.min("first_purchase").alias("first_purchase"),
        F.max("last_purchase").alias("last_purchase"),
        mean_of(F.sum("days"), F.sum("dated")).alias("avg_delivery_days"),
        mean_of(F.sum("score"), F.sum("scored")).alias("avg_review_score"),
        mean_of(F.sum("late"), F.sum("orders")).alias("pct_delayed"),
        mean_of(F.sum("weekend"), F.sum("orders")).alias("weekend_purchase_ratio"),
        F.min("place")["customer_state"].alias("state"),
        F.min("place")["customer_city"].alias("city"),
        F.min_by("payment_type", rank).alias("preferred_payment_method"),
    )


def preferred_payment(orders: DataFrame) -> DataFrame:
    """``customer_unique_id, preferred_payment_method``: most orders, ties to the alphabetically first."""
    return order_level(orders).select("customer_unique_id", "preferred_payment_method")


def add_recency(customers: DataFrame, reference: Column) -> DataFrame:
    """Days from first and last purchase to ``reference``, and between the two."""
    return customers.withColumns(
        {
            "days_since_first_purchase": floor_days(F.col("first_purchase"), reference),
            # Purchases on the reference day lie after its midnight and give -1.
            "days_since_last_purchase": floor_days(F.col("last_purchase"), reference),
            "customer_lifetime_days": floor_days(F.col("first_purchase"), F.col("last_purchase")),
        }
    )


def add_ratios(customers: DataFrame) -> DataFrame:
    orders = F.col("num_orders")
    spend = F.col("spend").cast("double")
    return customers.withColumns(
        {
            "total_spend": spend,
            "avg_order_value": mean_of(F.col("spend"), orders),
            "avg_basket_size": mean_of(F.col("total_products"), orders),
            "purchase_frequency": mean_of(orders, not_below(F.col("days_since_first_purchase"), 1)) * 30,
            "avg_freight_ratio": mean_of(F.col("freight"), not_below(spend, 0.01)),
        }
    )


def add_churn_label(features: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    """``churn`` is 1 for customers without a purchase in the last ``days`` days."""
    return features.withColumn("churn", flag(F.col("days_since_last_purchase") > days).cast("int"))


def assemble(
    by_item: DataFrame, by_order: DataFrame, reference: DataFrame, churn_days: int = CHURN_DAYS
) -> DataFrame:
    """Join the two aggregates, which are both partitioned by customer already, and derive the other columns."""
    dated = by_item.join(by_order, "customer_unique_id").withColumn("_reference", reference.scalar())
    features = add_churn_label(add_ratios(add_recency(dated, F.col("_reference"))), churn_days)
    return features.withColumns({c: half_even(F.col(c), ROUNDING) for c in ROUNDED}).select(*FEATURE_COLUMNS)


def customer_features(items: DataFrame, churn_days: int = CHURN_DAYS) -> DataFrame:
    """The full feature table from clean item rows, which are read three times: best from a stored table."""
    return assemble(item_level(items), order_level(orders_of(items)), reference_date(items), churn_days)


# What the item-level features are computed from.
ITEM_LEVEL_COLUMNS = ("customer_unique_id", "product_id", "seller_id", "price", "freight_value", "category")


def features_from_tables(tables: CommerceTables, churn_days: int = CHURN_DAYS) -> DataFrame:
    """The full feature table straight from the source tables.

    Each part makes only the joins it needs: item features skip payments and reviews, order features skip products
    and sellers, the reference date skips all of them.
    """
    return assemble(
        item_level(clean_items(tables, ITEM_LEVEL_COLUMNS)),
        order_level(clean_orders(tables)),
        reference_date(clean_orders(tables, ())),
        churn_days,
    )


def churn_rate(features: DataFrame) -> DataFrame:
    return features.agg(F.avg("churn").alias("churn_rate"))
