"""Item-level base datasets: delivered order items with customer, category, payment and review columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import exact_mean, flag, floor_days, month_key
from bazaarlens.sources.tables import CommerceTables

DELIVERED = "delivered"
UNKNOWN = "unknown"

ORDER_TIMES = (
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)

WIDE_COLUMNS = (
    "order_id",
    "month",
    *ORDER_TIMES,
    "customer_unique_id",
    "state",
    "city",
    "product_id",
    "price",
    "freight_value",
    "category",
    "payment_type",
    "review_score",
    "item_value",
    "delivery_days",
    "is_delayed",
)

CUSTOMER_COLUMNS = {"customer_unique_id", "state", "city", "customer_state", "customer_city"}

FEATURE_INPUT_COLUMNS = (
    "customer_unique_id",
    "customer_state",
    "customer_city",
    "order_id",
    *ORDER_TIMES,
    "product_id",
    "seller_id",
    "price",
    "freight_value",
    "category",
    "payment_type",
    "review_score",
)


def with_status(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    return orders.filter(F.col("order_status") == status)


def primary_payments(payments: DataFrame) -> DataFrame:
    """The first payment of each order: ``order_id, payment_type``."""
    return payments.filter(F.col("payment_sequential") == 1).select("order_id", "payment_type")


def review_scores(reviews: DataFrame) -> DataFrame:
    """One averaged ``review_score`` per order, so that repeated reviews do not multiply its items.

    It is a decimal, so that what averages it over items, customers or categories sums whole numbers.
    """
    mean = exact_mean(F.sum("review_score"), F.count("review_score"))
    return reviews.groupBy("order_id").agg(mean.alias("review_score"))


def product_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """``product_id, category``: the English name, else the original one, else ``unknown``."""
    return products.join(translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce("product_category_name_english", "product_category_name", F.lit(UNKNOWN)).alias("category"),
    )


def order_facts(tables: CommerceTables, columns: Iterable[str]) -> DataFrame:
    """Delivered orders, with customer, payment and review columns if asked for.

    Joining at order grain keeps these joins an order of magnitude narrower than on items. The left joins find at
    most one row per order (declared keys) and every order has its customer (declared reference), so leaving one out
    does not change the other columns.
    """
    needed = set(columns)
    facts = with_status(tables.orders).select("order_id", "customer_id", *ORDER_TIMES)
    if needed & CUSTOMER_COLUMNS:
        facts = facts.join(
            tables.customers.select(
                "customer_id",
                "customer_unique_id",
                F.col("customer_state").alias("state"),
                F.col("customer_city").alias("city"),
            ),
            "customer_id",
        )
    if "payment_type" in needed:
        facts = facts.join(primary_payments(tables.payments), "order_id", "left")
    if "review_score" in needed:
        facts = facts.join(review_scores(tables.reviews), "order_id", "left")
    return facts.drop("customer_id")


def _joined_items(tables: CommerceTables, columns: Iterable[str]) -> DataFrame:
    items = tables.order_items.select("order_id", "product_id", "seller_id", "price", "freight_value")
    if "category" in set(columns):
        categories = product_categories(tables.products, tables.product_category_translation)
        items = items.join(categories, "product_id", "left").fillna(UNKNOWN, "category")
    # The join by order comes last: what follows per order then finds its rows in place.
    return items.join(order_facts(tables, columns), "order_id")


def order_items_wide(tables: CommerceTables, columns: Iterable[str] = WIDE_COLUMNS) -> DataFrame:
    """One row per delivered order item, repeated lines included. Only joins that ``columns`` need are made."""
    columns = list(columns)
    purchased, delivered = F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    return (
        _joined_items(tables, columns)
        .withColumns(
            {
                "month": month_key(purchased),
                "item_value": F.col("price") + F.col("freight_value"),
                "delivery_days": floor_days(purchased, delivered),
                "is_delayed": flag(delivered > F.col("order_estimated_delivery_date")),
            }
        )
        .select(*columns)
    )


def feature_input(tables: CommerceTables, columns: Iterable[str] = FEATURE_INPUT_COLUMNS) -> DataFrame:
    """The uncleaned item rows that the customer features start from; undated orders are left out.

    Only joins that ``columns`` need are made.
    """
    columns = list(columns)
    return (
        _joined_items(tables, columns)
        .dropna(subset=["order_purchase_timestamp"])
        .withColumnsRenamed({"state": "customer_state", "city": "customer_city"})
        .select(*columns)
    )
