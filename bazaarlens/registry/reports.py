from __future__ import annotations

from bazaarlens.operators import reports
from bazaarlens.registry.core import register


def _mean(total: str, count: str) -> str:
    """Mean with two decimals, half away from zero, in whole hundredths: a quotient of doubles misses exact halves."""
    hundredths = f"CAST(({total}) * 100 AS HUGEINT)"
    return f"(CAST((2 * {hundredths} + {count}) // (2 * {count}) AS DOUBLE) / 100)"


_MONTH = "strftime(o.order_purchase_timestamp, '%Y-%m')"
_PAID = "v_orders o JOIN v_paid p ON o.order_id = p.order_id"
_DELIVERED = "o.order_status = 'delivered'"

register(
    "q01_monthly_orders",
    lambda s: reports.monthly_orders(s.tables),
    f"SELECT {_MONTH} AS month, COUNT(order_id) AS total_orders FROM v_orders o WHERE {_DELIVERED} GROUP BY 1",
)
register(
    "q02_monthly_revenue",
    lambda s: reports.monthly_revenue(s.tables),
    f"""SELECT {_MONTH} AS month, COUNT(DISTINCT o.order_id) AS total_orders,
               CAST(ROUND(SUM(order_total), 2) AS DOUBLE) AS total_revenue
        FROM {_PAID} WHERE {_DELIVERED} GROUP BY 1""",
)
register(
    "q03_avg_order_value",
    lambda s: reports.avg_order_value(s.tables),
    f"""SELECT {_MONTH} AS month, COUNT(DISTINCT o.order_id) AS total_orders,
               {_mean('SUM(order_total)', 'COUNT(order_total)')} AS avg_order_value
        FROM {_PAID} WHERE {_DELIVERED} GROUP BY 1""",
)
register(
    "q04_orders_by_state",
    lambda s: reports.orders_by_state(s.tables),
    f"""SELECT c.customer_state AS state, COUNT(DISTINCT o.order_id) AS total_orders,
               CAST(ROUND(SUM(order_total), 2) AS DOUBLE) AS total_revenue,
               {_mean('SUM(order_total)', 'COUNT(order_total)')} AS avg_order_value
        FROM {_PAID} JOIN v_customers c ON o.customer_id = c.customer_id
        WHERE {_DELIVERED} GROUP BY 1 ORDER BY total_orders DESC, state""",
)
register(
    "q05_payment_distribution",
    lambda s: reports.payment_distribution(s.tables),
    f"""SELECT payment_type, COUNT(DISTINCT order_id) AS total_orders,
              CAST(ROUND(SUM(payment_value), 2) AS DOUBLE) AS total_value,
              {_mean('SUM(payment_value)', 'COUNT(payment_value)')} AS avg_value,
              {_mean('100 * COUNT(DISTINCT order_id)', 'SUM(COUNT(DISTINCT order_id)) OVER ()')} AS pct_of_orders
       FROM v_payments GROUP BY payment_type""",
)
register(
    "q06_repeat_customers",
    lambda s: reports.repeat_customers(s.tables),
    f"""SELECT order_count, COUNT(customer_unique_id) AS num_customers
        FROM (SELECT c.customer_unique_id, COUNT(o.order_id) AS order_count
              FROM v_orders o JOIN v_customers c ON o.customer_id = c.customer_id
              WHERE {_DELIVERED} GROUP BY 1)
        GROUP BY order_count""",
)
# A product's category by its English name where there is one; products without any are not in it.
_CATEGORY = """(SELECT product_id, COALESCE((SELECT MIN(t.product_category_name_english) FROM v_translation t
                WHERE t.product_category_name = p.product_category_name), p.product_category_name) AS category
               FROM v_products p WHERE p.product_category_name IS NOT NULL)"""
register(
    "q07_revenue_by_category",
    lambda s: reports.revenue_by_category(s.tables),
    f"""WITH delivered AS (SELECT order_id FROM v_orders o WHERE {_DELIVERED}),
        lines AS (SELECT category, order_id, SUM(price) AS paid, COUNT(price) AS items
                  FROM v_order_items SEMI JOIN delivered USING (order_id) JOIN {_CATEGORY} USING (product_id) GROUP BY ALL)
        SELECT category, COUNT(*) AS total_orders, CAST(ROUND(SUM(paid), 2) AS DOUBLE) AS total_revenue,
               {_mean('SUM(paid)', 'SUM(items)')} AS avg_item_price
        FROM lines GROUP BY category""",
)
register(
    "q08_avg_review_score",
    lambda s: reports.avg_review_score(s.tables),
    # an order's reviews count once for each of its items, so both are counted before they meet
    f"""WITH opinion AS (SELECT order_id, COUNT(*) AS n, SUM(review_score) AS points, COUNT(review_score) AS given,
                        COUNT(*) FILTER (review_score > 3) AS liked, COUNT(*) FILTER (review_score < 3) AS disliked
                        FROM v_reviews WHERE order_id IN (SELECT order_id FROM v_orders o WHERE {_DELIVERED}) GROUP BY order_id),
        basket AS (SELECT order_id, category, COUNT(*) AS items FROM v_order_items JOIN v_categories USING (product_id) GROUP BY ALL)
        SELECT category, CAST(SUM(items * n) AS BIGINT) AS total_reviews,
               {_mean('SUM(items * points)', 'CAST(SUM(items * given) AS HUGEINT)')} AS avg_score,
               CAST(SUM(items * liked) AS BIGINT) AS positive_reviews, CAST(SUM(items * disliked) AS BIGINT) AS negative_reviews
        FROM basket JOIN opinion USING (order_id) GROUP BY category ORDER BY total_reviews DESC, category LIMIT 25""",
)
register(
    "q09_top_customers",
    lambda s: reports.top_customers(s.tables),
    f"""SELECT c.customer_unique_id,
               arg_min(c.customer_city, (o.order_purchase_timestamp, o.order_id)) AS customer_city,
               arg_min(c.customer_state, (o.order_purchase_timestamp, o.order_id)) AS customer_state,
               COUNT(DISTINCT o.order_id) AS total_orders, CAST(ROUND(SUM(order_total), 2) AS DOUBLE) AS lifetime_value
        FROM {_PAID} JOIN v_customers c ON o.customer_id = c.customer_id
        WHERE {_DELIVERED} GROUP BY 1 ORDER BY lifetime_value DESC, customer_unique_id LIMIT 20""",
)
register(
    "q10_top_products",
    lambda s: reports.top_products(s.tables),
    f"""SELECT i.product_id, COALESCE(MIN(p.product_category_name), 'unknown') AS category,
               COUNT(DISTINCT i.order_id) AS times_ordered, CAST(ROUND(SUM(i.price), 2) AS DOUBLE) AS total_revenue
        FROM v_order_items i JOIN v_orders o ON i.order_id = o.order_id
        LEFT JOIN v_products p ON i.product_id = p.product_id
        WHERE {_DELIVERED} GROUP BY 1 ORDER BY total_revenue DESC, i.product_id LIMIT 20""",
)
