"""Stand-alone business reports over the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.columns import mean_of, month_key
from bazaarlens.operators.base import UNKNOWN, with_status
from bazaarlens.sources.tables import CommerceTables


def _money(total):
    return F.round(total, 2).cast("double")


def _paid_per_order(payments: DataFrame) -> DataFrame:
    """Instalments summed per order first: joining them singly would repeat the order."""
    return payments.groupBy("order_id").agg(F.sum("payment_value").alias("order_total"))


def _paid_orders(tables: CommerceTables) -> DataFrame:
    """Delivered orders with their paid total; an order without payments drops out."""
    return with_status(tables.orders).join(_paid_per_order(tables.payments), "order_id")


def _paid_orders_of(tables: CommerceTables, *columns: str) -> DataFrame:
    """One row per delivered and paid order with its paid total and the given columns of order and customer.

    Customers join first and payments last, so that what follows per order finds its rows in place.
    """
    orders = with_status(tables.orders).join(tables.customers, "customer_id").select("order_id", *columns)
    paid = orders.join(_paid_per_order(tables.payments), "order_id")
    return paid.groupBy("order_id", *columns).agg(F.sum("order_total").alias("total"), F.count("order_total").alias("paid"))


def _average(total, count):
    return F.round(mean_of(total, count), 2)


def monthly_orders(tables: CommerceTables) -> DataFrame:
    return (
        with_status(tables.orders)
        .groupBy(month_key(F.col("order_purchase_timestamp")).alias("month"))
        .agg(F.count("order_id").alias("total_orders"))
        .orderBy("month")
    )


def monthly_revenue(tables: CommerceTables) -> DataFrame:
    return (
        _paid_orders(tables)
        .groupBy(month_key(F.col("order_purchase_timestamp")).alias("month"))
        .agg(F.countDistinct("order_id").alias("total_orders"), _money(F.sum("order_total")).alias("total_revenue"))
        .orderBy("month")
    )


def avg_order_value(tables: CommerceTables) -> DataFrame:
    return (
        _paid_orders(tables)
        .groupBy(month_key(F.col("order_purchase_timestamp")).alias("month"))
        .agg(
            F.countDistinct("order_id").alias("total_orders"),
            _average(F.sum("order_total"), F.count("order_total")).alias("avg_order_value"),
        )
        .orderBy("month")
    )


def orders_by_state(tables: CommerceTables) -> DataFrame:
    return (
        _paid_orders_of(tables, "customer_state")
        .groupBy(F.col("customer_state").alias("state"))
        .agg(
            F.count("order_id").alias("total_orders"),
            _money(F.sum("total")).alias("total_revenue"),
            _average(F.sum("total"), F.sum("paid")).alias("avg_order_value"),
        )
        .orderBy(F.desc("total_orders"), "state")
    )


def payment_distribution(tables: CommerceTables) -> DataFrame:
    """Payments of all orders by type; the average is per payment row, the share per distinct order."""
    by_type = tables.payments.groupBy("payment_type").agg(
        F.countDistinct("order_id").alias("total_orders"),
        _money(F.sum("payment_value")).alias("total_value"),
        _average(F.sum("payment_value"), F.count("payment_value")).alias("avg_value"),
    )
    # The window runs over one row per payment type.
    everything = F.sum("total_orders").over(Window.partitionBy())
    return by_type.withColumn(
        "pct_of_orders", F.round(F.try_divide(F.col("total_orders") * 100.0, everything), 2).cast("double")
    ).orderBy(F.desc("total_orders"), "payment_type")


def repeat_customers(tables: CommerceTables) -> DataFrame:
    """How many people placed one delivered order, two, and so on."""
    return (
        with_status(tables.orders)
        .join(tables.customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(F.count("order_id").alias("order_count"))
        .groupBy("order_count")
        .agg(F.count("customer_unique_id").alias("num_customers"))
        .orderBy("order_count")
    )


def revenue_by_category(tables: CommerceTables) -> DataFrame:
    """Item prices without freight; products without a category are left out."""
    named = (
        tables.products.select("product_id", "product_category_name")
        .dropna(subset=["product_category_name"])
        .join(tables.product_category_translation, "product_category_name", "left")
        .select(
            "product_id",
            F.coalesce("product_category_name_english", "product_category_name").alias("category"),
        )
    )
    return (
        tables.order_items.select("order_id", "product_id", "price")
        .join(with_status(tables.orders).select("order_id"), "order_id")
        .join(named, "product_id")
        .groupBy("category")
        .agg(
            F.countDistinct("order_id").alias("total_orders"),
            _money(F.sum("price")).alias("total_revenue"),
            _average(F.sum("price"), F.count("price")).alias("avg_item_price"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def avg_review_score(tables: CommerceTables, limit: int = 25) -> DataFrame:
    """Reviews per category, each review counted once for every item of its order.

    The review-by-item pairs are never made: reviews are counted per order and items per order and product, and a
    product's share of an order is the product of the two counts.
    """
    score = F.col("review_score")
    reviews = tables.reviews.groupBy("order_id").agg(
        F.count("review_id").alias("reviews"),
        F.sum(score).alias("score"),
        F.count(score).alias("scored"),
        F.count_if(score >= 4).alias("positive"),
        F.count_if(score <= 2).alias("negative"),
    )
    lines = tables.order_items.groupBy("order_id", "product_id").agg(F.count("*").alias("items"))
    measures = ("reviews", "score", "scored", "positive", "negative")
    by_product = (
        lines.join(with_status(tables.orders).select("order_id"), "order_id")
        .join(reviews, "order_id")
        .groupBy("product_id")
        .agg(*[F.sum(F.col("items") * F.col(m)).alias(m) for m in measures])
    )
    categories = tables.products.join(
        tables.product_category_translation, "product_category_name", "left"
    ).select(
        "product_id",
        F.coalesce("product_category_name_english", "product_category_name", F.lit(UNKNOWN)).alias("category"),
    )
    return (
        by_product.join(categories, "product_id")
        .groupBy("category")
        .agg(
            F.sum("reviews").alias("total_reviews"),
            _average(F.sum("score"), F.sum("scored")).alias("avg_score"),
            F.sum("positive").alias("positive_reviews"),
            F.sum("negative").alias("negative_reviews"),
        )
        .orderBy(F.desc("total_reviews"), "category")
        .limit(limit)
    )


def top_customers(tables: CommerceTables, limit: int = 20) -> DataFrame:
    """Customers by lifetime value; city and state are those of the earliest order."""
    place = ("order_purchase_timestamp", "customer_city", "customer_state")
    earliest = F.struct(F.col(place[0]).isNull(), place[0], "order_id")
    return (
        _paid_orders_of(tables, "customer_unique_id", *place)
        .groupBy("customer_unique_id")
        .agg(
            F.min_by(F.struct("customer_city", "customer_state"), earliest).alias("place"),
            F.count("order_id").alias("total_orders"),
            _money(F.sum("total")).alias("lifetime_value"),
        )
        .select("customer_unique_id", "place.customer_city", "place.customer_state", "total_orders", "lifetime_value")
        .orderBy(F.desc("lifetime_value"), "customer_unique_id")
        .limit(limit)
    )


def top_products(tables: CommerceTables, limit: int = 20) -> DataFrame:
    """Products by revenue, under their original category name.

    Names are looked up after the ranking, for ``limit`` products and not for every item.
    """
    top = (
        tables.order_items.select("order_id", "product_id", "price")
        .join(with_status(tables.orders).select("order_id"), "order_id")
        .groupBy("product_id")
        .agg(F.countDistinct("order_id").alias("times_ordered"), _money(F.sum("price")).alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "product_id")
        .limit(limit)
    )
    return (
        top.join(tables.products.select("product_id", "product_category_name"), "product_id", "left")
        .select(
            "product_id",
            F.coalesce("product_category_name", F.lit(UNKNOWN)).alias("category"),
            "times_ordered",
            "total_revenue",
        )
        .orderBy(F.desc("total_revenue"), "product_id")
    )
