from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.operators import features
from bazaarlens.operators.cleaning import clean_items
from bazaarlens.registry.core import Source, register, settled
from bazaarlens.registry.views import he, mean

_ID = "customer_unique_id"

register(
    "f00_reference_date",
    lambda s: features.reference_date(s.clean_orders),
    "SELECT d AS reference_date FROM v_reference",
)


def _item_level(s: Source, *columns: str):
    return features.item_level(clean_items(s.tables, features.ITEM_LEVEL_COLUMNS)).select(_ID, *columns)


register(
    "f01_total_spend",
    lambda s: _item_level(s, "spend").select(_ID, F.col("spend").cast("double").alias("total_spend")),
    "SELECT customer_unique_id, CAST(spend AS DOUBLE) AS total_spend FROM v_item_level",
)
for _name, _column in (
    ("f02_total_products", "total_products"),
    ("f03_distinct_categories", "distinct_categories"),
    ("f04_distinct_sellers", "distinct_sellers"),
):
    register(
        _name,
        lambda s, column=_column: _item_level(s, column),
        f"SELECT customer_unique_id, {_column} FROM v_item_level",
    )
for _name, _columns in (
    ("f05_num_orders", ("num_orders",)),
    ("f06_avg_delivery_days", ("avg_delivery_days",)),
    ("f07_avg_review_score", ("avg_review_score",)),
    ("f08_pct_delayed", ("pct_delayed",)),
    ("f09_weekend_purchase_ratio", ("weekend_purchase_ratio",)),
    ("f10_state_city", ("state", "city")),
):
    _fraction = _columns[0].startswith(("avg", "pct", "weekend"))
    register(
        _name,
        lambda s, columns=_columns: settled(features.order_level(s.clean_orders).select(_ID, *columns)),
        "SELECT customer_unique_id, "
        + ", ".join(f"{he(c)} AS {c}" if _fraction else c for c in _columns)
        + " FROM v_order_level",
    )


def _recency(s: Source):
    dated = features.order_level(s.clean_orders).withColumn("_reference", features.reference_date(s.clean_orders).scalar())
    return features.add_recency(dated, F.col("_reference"))


for _name, _column in (
    ("f11_days_since_first_purchase", "days_since_first_purchase"),
    ("f12_days_since_last_purchase", "days_since_last_purchase"),
    ("f13_customer_lifetime_days", "customer_lifetime_days"),
):
    register(
        _name,
        lambda s, column=_column: _recency(s).select(_ID, column),
        f"SELECT customer_unique_id, {_column} FROM v_recency",
    )
register(
    "f14_preferred_payment",
    lambda s: features.preferred_payment(s.clean_orders),
    "SELECT customer_unique_id, preferred_payment_method FROM v_preferred",
)
for _name, _column in (
    ("f15_avg_order_value", "avg_order_value"),
    ("f16_avg_basket_size", "avg_basket_size"),
    ("f17_purchase_frequency", "purchase_frequency"),
    ("f18_avg_freight_ratio", "avg_freight_ratio"),
    ("f19_churn_label", "churn"),
):
    register(
        _name,
        lambda s, column=_column: s.features.select(_ID, column),
        f"SELECT customer_unique_id, {_column} FROM v_features",
    )
register(
    "f19_churn_label_365_days",
    lambda s: features.add_churn_label(_recency(s), 365).select(_ID, "churn"),
    "SELECT customer_unique_id, CASE WHEN days_since_last_purchase > 365 THEN 1 ELSE 0 END AS churn FROM v_recency",
)
register(
    "f20_churn_rate",
    lambda s: settled(features.churn_rate(s.features)),
    f"SELECT {he(mean('SUM(churn)', 'COUNT(*)'))} AS churn_rate FROM v_features",
)
register(
    "f21_customer_features",
    lambda s: s.features,
    f"SELECT {', '.join(features.FEATURE_COLUMNS)} FROM v_features",
)
register(
    "f21_customer_features_of_items",
    lambda s: features.customer_features(s.clean),
    f"SELECT {', '.join(features.FEATURE_COLUMNS)} FROM v_features",
)
