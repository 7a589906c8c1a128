"""Headline figures over item rows and the customer feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import as_double, display_number, half_even, mean_of, number_text
from bazaarlens.functions.storage import materialise
from bazaarlens.operators.product import bottom_category_revenue, top_category_revenue
from bazaarlens.operators.regional import top_state_revenue
from bazaarlens.operators.sales import monthly_revenue, payment_order_counts


def _order_totals(items: DataFrame) -> DataFrame:
    """One row of totals, rolled up order, customer, all: distinct counts become plain counts."""
    orders = items.groupBy("customer_unique_id", "order_id").agg(
        F.sum("item_value").alias("value"),
        F.sum("review_score").alias("score"),
        F.count("review_score").alias("scored"),
        F.max("review_score").alias("order_score"),
        F.sum("delivery_days").alias("days"),
        F.count("delivery_days").alias("dated"),
        F.sum("is_delayed").alias("late"),
        F.count("*").alias("items"),
    )
    measures = ("value", "score", "scored", "order_score", "days", "dated", "late", "items")
    customers = orders.groupBy("customer_unique_id").agg(
        F.count("order_id").alias("orders"),
        F.count("order_score").alias("scored_orders"),
        *[F.sum(m).alias(m) for m in measures],
    )
    return customers.agg(
        F.count("customer_unique_id").alias("customers"),
        F.sum("orders").alias("orders"),
        F.sum("scored_orders").alias("scored_orders"),
        *[F.sum(m).alias(m) for m in measures],
    )


def _customer_rates(features: DataFrame) -> Column:
    """Churn and repeat rate in percent as one struct, so that both come from one run over the features."""
    rates = F.struct(
        (F.avg("churn") * 100).alias("churn"),
        (mean_of(F.count_if(F.col("num_orders") > 1), F.count("*")) * 100).alias("repeat"),
    )
    return features.agg(rates).scalar()


def executive_kpis(items: DataFrame, features: DataFrame) -> DataFrame:
    """Revenue, orders, customers, order value, review and churn as one row.

    The review mean is weighted by item; ``avg_review_per_order`` weights every reviewed order once.
    """
    return _order_totals(items).select(
        as_double(F.col("value")).alias("total_revenue"),
        F.col("orders").alias("total_orders"),
        "customers",
        mean_of(F.col("value"), F.col("orders")).alias("avg_order_value"),
        mean_of(F.col("score"), F.col("scored")).alias("avg_review_item_weighted"),
        mean_of(F.col("order_score"), F.col("scored_orders")).alias("avg_review_per_order"),
        _customer_rates(features)["churn"].alias("churn_rate_pct"),
    )


def report_kpis(items: DataFrame, features: DataFrame) -> DataFrame:
    """The eight figures of the printed report as one row."""
    return _order_totals(items).select(
        as_double(F.col("value")).alias("total_revenue"),
        F.col("orders").alias("total_orders"),
        F.col("customers").alias("unique_customers"),
        mean_of(F.col("value"), F.col("orders")).alias("avg_order_value"),
        mean_of(F.col("score"), F.col("scored")).alias("avg_review_item_weighted"),
        _customer_rates(features)["churn"].alias("churn_rate_pct"),
        _customer_rates(features)["repeat"].alias("repeat_rate_pct"),
        (mean_of(F.col("late"), F.col("items")) * 100).alias("late_pct_item_weighted"),
    )


def best_and_worst_month(items: DataFrame) -> DataFrame:
    """Months with the highest and lowest revenue; the earlier month wins a tie."""
    monthly = monthly_revenue(items)
    by_high, by_low = F.struct(-F.col("revenue"), "month"), F.struct("revenue", "month")
    return monthly.agg(
        F.min_by("month", by_high).alias("best_month"),
        F.max("revenue").alias("best_revenue"),
        F.min_by("month", by_low).alias("worst_month"),
        F.min("revenue").alias("worst_revenue"),
    )


# Names of the business-context entries and the decimals of each scalar.
CONTEXT_SCALARS = {
    "total_revenue_BRL": 2,
    "total_orders": 0,
    "total_unique_customers": 0,
    "avg_order_value_BRL": 2,
    "avg_review_score_out_of_5": 2,
    "churn_rate_percent": 1,
    "repeat_customer_rate_percent": 1,
    "avg_delivery_days": 1,
    "pct_orders_delayed": 1,
}
CONTEXT_INPUTS = (
    "customer_unique_id",
    "order_id",
    "state",
    "category",
    "payment_type",
    "item_value",
    "review_score",
    "delivery_days",
    "is_delayed",
)
CONTEXT_COUNTS = ("total_orders", "total_unique_customers")
CONTEXT_MAPS = (
    "top_5_categories_by_revenue",
    "bottom_5_categories_by_revenue",
    "top_5_states_by_revenue",
    "payment_method_order_share",
)


def business_context_entries(items: DataFrame, features: DataFrame) -> DataFrame:
    """The business context in long form: ``metric, key, value``; ``key`` is null for the scalars.

    Totals, rankings and payments read the items apart, so the columns they need are written once.
    """
    items = materialise(items.select(*CONTEXT_INPUTS), "context-items")
    values = {
        "total_revenue_BRL": as_double(F.col("value")),
        "total_orders": as_double(F.col("orders")),
        "total_unique_customers": as_double(F.col("customers")),
        "avg_order_value_BRL": mean_of(F.col("value"), F.col("orders")),
        "avg_review_score_out_of_5": mean_of(F.col("score"), F.col("scored")),
        "churn_rate_percent": _customer_rates(features)["churn"],
        "repeat_customer_rate_percent": _customer_rates(features)["repeat"],
        "avg_delivery_days": mean_of(F.col("days"), F.col("dated")),
        "pct_orders_delayed": mean_of(F.col("late"), F.col("items")) * 100,
    }
    scalars = (
        _order_totals(items)
        .select(*[half_even(values[name], digits).alias(name) for name, digits in CONTEXT_SCALARS.items()])
        .unpivot([], list(CONTEXT_SCALARS), "metric", "value")
        .select("metric", F.lit(None).cast("string").alias("key"), "value")
    )
    # The three rankings read the items once, summed by category and state.
    cells = items.groupBy("category", "state").agg(F.sum("item_value").alias("item_value"))
    listed = {
        "top_5_categories_by_revenue": (top_category_revenue(cells, 5), "category", "revenue"),
        "bottom_5_categories_by_revenue": (bottom_category_revenue(cells, 5), "category", "revenue"),
        "top_5_states_by_revenue": (top_state_revenue(cells, 5), "state", "revenue"),
        "payment_method_order_share": (payment_order_counts(items), "payment_type", "orders"),
    }
    parts = [
        df.select(
            F.lit(name).alias("metric"),
            F.col(key).cast("string").alias("key"),
            half_even(F.col(value), 2).alias("value"),
        )
        for name, (df, key, value) in listed.items()
    ]
    return reduce(DataFrame.unionByName, parts, scalars)


def business_context(items: DataFrame, features: DataFrame) -> DataFrame:
    """The business context as one row of scalars and maps, with the same content as JSON text.

    Only the few entries of the long form are gathered.
    """
    entries = business_context_entries(items, features)
    metric, value = F.col("metric"), F.col("value")
    scalars = [
        F.max(F.when(metric == name, value)).cast("bigint" if name in CONTEXT_COUNTS else "double").alias(name)
        for name in CONTEXT_SCALARS
    ]
    maps = [
        F.map_from_entries(F.collect_list(F.when(metric == name, F.struct("key", "value")))).alias(name)
        for name in CONTEXT_MAPS
    ]
    row = entries.agg(*scalars, *maps)
    return row.withColumn("context_json", F.to_json(F.struct(*row.columns)))


def display_kpis(items: DataFrame, features: DataFrame) -> DataFrame:
    """The executive figures as headline text."""
    kpis = executive_kpis(items, features)
    return kpis.select(
        display_number(F.col("total_revenue"), currency=True).alias("total_revenue"),
        display_number(F.col("total_orders")).alias("total_orders"),
        display_number(F.col("customers")).alias("customers"),
        display_number(F.col("avg_order_value"), currency=True).alias("avg_order_value"),
        number_text(F.col("avg_review_item_weighted"), "%.2f / 5", 2).alias("avg_review"),
        number_text(F.col("churn_rate_pct"), "%.1f%%", 1).alias("churn_rate"),
    )
