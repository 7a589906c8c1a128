from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.storage import materialise
from bazaarlens.operators import product, regional, sales, sketches
from bazaarlens.registry.core import Source, register, settled
from bazaarlens.registry.views import he, mean

_REVENUE = "CAST(SUM(item_value) AS DOUBLE) AS revenue"
_ORDERS = "COUNT(DISTINCT order_id) AS orders"
_CATEGORY = f"""SELECT category, {_REVENUE}, {_ORDERS},
    {he(mean('SUM(review_score)', 'COUNT(review_score)'))} AS avg_review FROM v_wide GROUP BY category"""
_STATE = f"""SELECT state, {_REVENUE}, {_ORDERS}, COUNT(DISTINCT customer_unique_id) AS customers,
    {he(mean('SUM(delivery_days)', 'COUNT(delivery_days)'))} AS avg_delivery,
    {he(mean('SUM(is_delayed)', 'COUNT(*)'))} AS pct_delayed FROM v_wide GROUP BY state"""
_CATEGORY_INPUT = ("category", "order_id", "item_value", "review_score")
_STATE_INPUT = ("state", "customer_unique_id", "order_id", "item_value", "delivery_days", "is_delayed")

register(
    "a01_monthly_revenue",
    lambda s: sales.monthly_revenue(s.items("month", "item_value")),
    f"SELECT month, {_REVENUE} FROM v_wide WHERE month IS NOT NULL GROUP BY month",
)
register(
    "a02_monthly_orders",
    lambda s: sales.monthly_orders(s.items("month", "order_id")),
    f"SELECT month, {_ORDERS} FROM v_wide WHERE month IS NOT NULL GROUP BY month",
)
register(
    "a03_monthly_growth",
    lambda s: settled(sales.monthly_growth(s.items("month", "order_id", "item_value"))),
    f"""SELECT month, revenue, orders, {he('(revenue / LAG(revenue) OVER (ORDER BY month) - 1) * 100')} AS growth_pct
        FROM (SELECT month, {_REVENUE}, {_ORDERS} FROM v_wide WHERE month IS NOT NULL GROUP BY month)""",
)
register(
    "a04_category_trend",
    lambda s: sales.category_trend(s.items("month", "category", "item_value")),
    f"""SELECT month, category, {_REVENUE} FROM v_wide
        WHERE month IS NOT NULL AND category IN (SELECT category FROM v_wide GROUP BY category
            ORDER BY SUM(item_value) DESC, category LIMIT 8)
        GROUP BY month, category""",
)
register(
    "a05_top_products",
    lambda s: sales.top_products(s.items("product_id", "item_value")),
    f"SELECT product_id, {_REVENUE} FROM v_wide GROUP BY product_id ORDER BY revenue DESC, product_id LIMIT 15",
)
register(
    "a06_bottom_products",
    lambda s: sales.bottom_products(s.items("product_id", "item_value")),
    f"SELECT product_id, {_REVENUE} FROM v_wide GROUP BY product_id ORDER BY revenue, product_id LIMIT 15",
)
register(
    "a07_monthly_aov",
    lambda s: settled(sales.monthly_aov(s.items("month", "order_id", "item_value"))),
    f"""SELECT month, {he(mean('SUM(v)', 'COUNT(v)'))} AS aov
        FROM (SELECT month, order_id, SUM(item_value) AS v FROM v_wide GROUP BY month, order_id)
        WHERE month IS NOT NULL GROUP BY month""",
)
register(
    "a08_payment_breakdown",
    lambda s: sales.payment_breakdown(
        s.items("order_id", "product_id", "price", "freight_value", "payment_type", "item_value")
    ),
    """SELECT payment_type, COUNT(*) AS orders, CAST(SUM(first_value) AS DOUBLE) AS revenue,
              CAST(SUM(order_value) AS DOUBLE) AS order_revenue
       FROM (SELECT order_id, MIN(payment_type) AS payment_type, SUM(item_value) AS order_value,
                    arg_min(item_value, (product_id, -price, freight_value)) AS first_value
             FROM v_wide GROUP BY order_id)
       WHERE payment_type IS NOT NULL GROUP BY payment_type""",
)
register(
    "a09_top_categories",
    lambda s: product.ranked_categories(s.items("category", "item_value")),
    f"""SELECT category, revenue, CAST(ROW_NUMBER() OVER (ORDER BY revenue DESC, category) AS INT) AS rank
        FROM (SELECT category, {_REVENUE} FROM v_wide GROUP BY category ORDER BY revenue DESC, category LIMIT 10)""",
)
register(
    "a10_category_performance",
    lambda s: settled(product.category_performance(s.items(*_CATEGORY_INPUT))),
    _CATEGORY,
)
register(
    "a11_top_categories_by_revenue",
    lambda s: settled(product.top_categories(s.items(*_CATEGORY_INPUT), "revenue", 15)),
    f"{_CATEGORY} ORDER BY revenue DESC, category LIMIT 15",
)
register(
    "a12_top_categories_by_orders",
    lambda s: settled(product.top_categories(s.items(*_CATEGORY_INPUT), "orders", 15)),
    f"{_CATEGORY} ORDER BY orders DESC, category LIMIT 15",
)
register(
    "a13_revenue_orders_review",
    lambda s: settled(product.top_categories(s.items(*_CATEGORY_INPUT), "revenue", 30)),
    f"{_CATEGORY} ORDER BY revenue DESC, category LIMIT 30",
)
for _name, _least in (("a14_best_rated_categories", 50), ("a14_best_rated_large_categories", 140)):
    register(
        _name,
        lambda s, least=_least: settled(product.best_rated_categories(s.items(*_CATEGORY_INPUT), least)),
        f"""SELECT category, {_REVENUE}, {_ORDERS},
                   {he(mean('SUM(review_score)', 'COUNT(review_score)'))} AS avg_review FROM v_wide GROUP BY category
            HAVING COUNT(DISTINCT order_id) >= {_least} AND COUNT(review_score) > 0
            ORDER BY {mean('SUM(review_score)', 'COUNT(review_score)')} DESC, category LIMIT 20""",
    )
register("a15_state_performance", lambda s: settled(regional.state_performance(s.items(*_STATE_INPUT))), _STATE)
for _by in ("revenue", "orders", "avg_delivery", "pct_delayed"):
    register(
        f"a16_states_by_{_by}",
        lambda s, by=_by: settled(regional.state_ranking(s.items(*_STATE_INPUT), by)),
        f"{_STATE} ORDER BY {_by} DESC, state",
    )
register(
    "a17_top_cities",
    lambda s: regional.top_cities(s.items("state", "city", "order_id", "item_value")),
    f"""SELECT state, city, {_REVENUE}, {_ORDERS},
               concat(array_to_string(list_transform(string_split(city, ' '),
                      lambda w: concat(upper(w[1]), lower(w[2:]))), ' '), ' (', state, ')') AS label
        FROM v_wide GROUP BY state, city ORDER BY revenue DESC, state, city LIMIT 20""",
)
register(
    "a18_top_states",
    lambda s: settled(regional.top_states(s.items(*_STATE_INPUT))),
    f"""SELECT state, {_REVENUE}, {_ORDERS},
               {he(mean('SUM(delivery_days)', 'COUNT(delivery_days)'))} AS avg_delivery,
               {he(mean('SUM(is_delayed)', 'COUNT(*)') + ' * 100')} AS pct_delayed
        FROM v_wide GROUP BY state ORDER BY revenue DESC, state LIMIT 10""",
)
register(
    "a19_top_five_categories",
    lambda s: product.top_category_revenue(s.items("category", "item_value"), 5),
    f"SELECT category, {_REVENUE} FROM v_wide GROUP BY category ORDER BY revenue DESC, category LIMIT 5",
)
register(
    "a19_bottom_five_categories",
    lambda s: product.bottom_category_revenue(s.items("category", "item_value"), 5),
    f"SELECT category, {_REVENUE} FROM v_wide GROUP BY category ORDER BY revenue, category LIMIT 5",
)
register(
    "a19_top_five_states",
    lambda s: regional.top_state_revenue(s.items("state", "item_value"), 5),
    f"SELECT state, {_REVENUE} FROM v_wide GROUP BY state ORDER BY revenue DESC, state LIMIT 5",
)
register(
    "a20_payment_order_counts",
    lambda s: sales.payment_order_counts(s.items("order_id", "payment_type")),
    f"SELECT payment_type, {_ORDERS} FROM v_wide WHERE payment_type IS NOT NULL GROUP BY payment_type",
)


def _monthly_orders_by_sketch(source: Source) -> DataFrame:
    items = source.items("month", "order_id", "order_purchase_timestamp")
    stored = materialise(sketches.day_sketches(items, ["order_id"]), "day-sketches")
    about = sketches.distinct_counts(stored, ["order_id"], [F.date_format(sketches.DAY, "yyyy-MM").alias("month")])
    about = about.withColumnRenamed("order_id", "orders")
    return sketches.compared(sales.monthly_orders(items), about, "month", ["orders"])


def _states_by_sketch(source: Source) -> DataFrame:
    values = ["order_id", "customer_unique_id"]
    items = source.items("state", "order_purchase_timestamp", *values)
    stored = materialise(sketches.day_sketches(items, values, ["state"]), "day-sketches")
    exact = items.groupBy("state").agg(*[F.countDistinct(v).alias(v) for v in values])
    return sketches.compared(exact, sketches.distinct_counts(stored, values, ["state"]), "state", values)


register(
    "a02_monthly_orders_by_sketch",
    _monthly_orders_by_sketch,
    f"SELECT month, {_ORDERS}, TRUE AS orders_within FROM v_wide WHERE month IS NOT NULL GROUP BY month",
)
register(
    "a15_states_by_sketch",
    _states_by_sketch,
    """SELECT state, COUNT(DISTINCT order_id) AS order_id, COUNT(DISTINCT customer_unique_id) AS customer_unique_id,
              TRUE AS order_id_within, TRUE AS customer_unique_id_within FROM v_wide GROUP BY state""",
)
