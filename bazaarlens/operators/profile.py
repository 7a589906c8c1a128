"""Descriptive statistics of the customer feature table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import half_even, mean_of, number_text, seeded_order

SEED = 42

# Columns of the two correlation matrices, of the summary and of the profile.
CORRELATION_COLUMNS = (
    "num_orders",
    "total_spend",
    "avg_order_value",
    "avg_basket_size",
    "purchase_frequency",
    "customer_lifetime_days",
    "days_since_first_purchase",
    "days_since_last_purchase",
    "avg_delivery_days",
    "avg_review_score",
    "pct_delayed",
    "weekend_purchase_ratio",
    "distinct_categories",
    "avg_freight_ratio",
    "churn",
)
SHORT_CORRELATION_COLUMNS = (
    "num_orders",
    "total_spend",
    "avg_order_value",
    "avg_delivery_days",
    "avg_review_score",
    "pct_delayed",
    "avg_freight_ratio",
    "customer_lifetime_days",
    "churn",
)
SUMMARY_COLUMNS = ("customer_unique_id", "num_orders", "total_spend", "avg_order_value", "avg_review_score")
PROFILE_COLUMNS = (
    "num_orders",
    "total_spend",
    "avg_order_value",
    "avg_review_score",
    "pct_delayed",
    "avg_delivery_days",
    "customer_lifetime_days",
    "state",
    "preferred_payment_method",
)


def churn_label(column: str = "churn") -> Column:
    return F.when(F.col(column) == 0, "Active").when(F.col(column) == 1, "Churned")


def dataset_summary(features: DataFrame) -> DataFrame:
    total, churned = F.count("*"), F.sum("churn")
    return features.agg(
        total.alias("customers"),
        churned.alias("churned"),
        (mean_of(churned, total) * 100).alias("churned_pct"),
        (total - churned).alias("active"),
        (100 - mean_of(churned, total) * 100).alias("active_pct"),
        F.avg("total_spend").alias("avg_spend"),
        F.avg("num_orders").alias("avg_orders"),
        F.avg("avg_review_score").alias("avg_review"),
        F.avg("avg_delivery_days").alias("avg_delivery_days"),
    )


def churn_split(features: DataFrame) -> DataFrame:
    return features.groupBy(churn_label().alias("label")).agg(F.count("*").alias("customers"))


def review_distribution(features: DataFrame) -> DataFrame:
    """Customers per mean review score, rounded half-to-even to a whole score."""
    return (
        features.dropna(subset=["avg_review_score"])
        .groupBy(F.rint("avg_review_score").cast("int").alias("score"))
        .agg(F.count("*").alias("customers"))
        .orderBy("score")
    )


def spend_histogram(features: DataFrame, bins: int = 80, column: str = "total_spend") -> DataFrame:
    """Counts in ``bins`` ranges of equal width from the smallest to the largest value; empty bins are left out.

    The range comes from its own one-row aggregate, so the values are never gathered.
    """
    span = features.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    width = (F.col("high") - F.col("low")) / bins
    placed = features.dropna(subset=[column]).select(
        F.col(column).alias("value"), span["low"].alias("low"), span["high"].alias("high")
    )
    index = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("low"), width)), F.lit(0))
    return (
        placed.groupBy(F.least(index, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(
            F.count("*").alias("customers"),
            F.max(F.col("low")).alias("low"),
            F.max(width).alias("width"),
        )
        .select(
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
            "customers",
        )
        .orderBy("bin")
    )


def _order_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("num_orders").agg(F.count("*").alias("customers"))


def orders_distribution(features: DataFrame, limit: int = 15) -> DataFrame:
    """Customers per number of orders, for the ``limit`` smallest numbers."""
    return _order_counts(features).orderBy("num_orders").limit(limit)


def common_order_counts(features: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` most frequent numbers of orders."""
    return _order_counts(features).orderBy(F.desc("customers"), "num_orders").limit(limit)


def churn_by_state(features: DataFrame, limit: int = 15) -> DataFrame:
    """States with the highest churn rate in percent, one decimal."""
    rates = (
        features.dropna(subset=["state"])
        .groupBy("state")
        .agg(half_even(mean_of(F.sum("churn"), F.count("churn")) * 100, 1).alias("churn_rate_pct"))
    )
    return rates.orderBy(F.desc("churn_rate_pct"), "state").limit(limit)


def correlation_matrix(features: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Pearson correlation of every pair of ``columns``, in long form and both directions.

    Rows with a null in either column are skipped for that pair alone. The table is read once: a row's values become its
    pairs, which each task merges to one set of moments a pair before anything is shuffled. So the aggregate stays narrow
    enough for generated code, which one over all pairs at once does not.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    pair = F.explode(F.lit([f"{i} {j}" for i, j in pairs]))
    values = F.array(*[F.col(c).cast("double") for c in columns])
    rows = features.select(values.alias("values"), pair.alias("pair"))
    place = [F.split_part("pair", F.lit(" "), F.lit(k)).cast("int") for k in (1, 2)]
    found = (
        rows.select("pair", F.get("values", place[0]).alias("a"), F.get("values", place[1]).alias("b"))
        .groupBy("pair")
        .agg(half_even(F.corr("a", "b"), 2).alias("r"))
    )
    names = F.lit(list(columns))
    cell = lambda a, b: F.struct(F.get(names, a).alias("column_a"), F.get(names, b).alias("column_b"), F.col("r"))
    both = F.when(place[0] == place[1], F.array(cell(*place))).otherwise(F.array(cell(*place), cell(*place[::-1])))
    return found.select(F.inline(both))


def buyer_types(features: DataFrame) -> DataFrame:
    """Single and repeat buyers with their share of both in percent."""
    counts = features.agg(
        F.count_if(F.col("num_orders") == 1).alias("single"), F.count_if(F.col("num_orders") > 1).alias("repeat")
    )
    total = F.col("single") + F.col("repeat")
    rows = F.array(
        F.struct(F.lit("Single Purchase").alias("segment"), F.col("single").alias("customers"), total.alias("all")),
        F.struct(F.lit("Repeat Buyers").alias("segment"), F.col("repeat").alias("customers"), total.alias("all")),
    )
    return counts.select(F.inline(rows)).select(
        "segment", "customers", (mean_of(F.col("customers"), F.col("all")) * 100).alias("pct_of_base")
    )


def mean_by_churn(features: DataFrame, column: str) -> DataFrame:
    """Mean of ``column`` for active and churned customers."""
    return (
        features.groupBy("churn")
        .agg(F.avg(column).alias(column))
        .select("churn", churn_label().alias("label"), column)
        .orderBy("churn")
    )


def customer_sample(features: DataFrame, size: int = 3000, seed: int = SEED) -> DataFrame:
    """``size`` customers, the same ones for a seed however the data is partitioned."""
    return features.orderBy(seeded_order(F.col("customer_unique_id"), seed), "customer_unique_id").limit(size)


def spend_orders_sample(features: DataFrame, size: int = 3000, seed: int = SEED) -> DataFrame:
    """The sampled customers with spend, orders and status, for a scatter plot."""
    narrow = features.select("customer_unique_id", "total_spend", "num_orders", churn_label().alias("status"))
    return customer_sample(narrow, size, seed)


def customer_summary(features: DataFrame) -> DataFrame:
    return features.select(*SUMMARY_COLUMNS)


def customer_choices(features: DataFrame, limit: int = 300) -> DataFrame:
    """The first ``limit`` customer ids to choose from."""
    return features.select("customer_unique_id").orderBy("customer_unique_id").limit(limit)


def customer_profile(features: DataFrame, customer_id: Column | str | int) -> DataFrame:
    """The profile columns of one customer as text, fractional numbers with two decimals."""
    one = features.filter(F.col("customer_unique_id") == customer_id)
    return profile_text(one)


def profile_text(features: DataFrame) -> DataFrame:
    kinds = dict(features.dtypes)
    return features.select(
        "customer_unique_id",
        *[
            (number_text(F.col(c), "%.2f", 2) if kinds[c] == "double" else F.col(c).cast("string")).alias(c)
            for c in PROFILE_COLUMNS
        ],
    )
