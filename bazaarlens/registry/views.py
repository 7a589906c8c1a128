"""SQL definitions of the source tables and base datasets for the independent check (see ``FIXTURES.md``)."""

from __future__ import annotations

import re


def he(expression: str, digits: int = 4) -> str:
    """Half-to-even rounding of a double by scaling."""
    return f"(round_even(CAST({expression} AS DOUBLE) * 1e{digits}, 0) / 1e{digits})"


def days(start: str, end: str) -> str:
    """Whole 24-hour periods, rounded down."""
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0) AS BIGINT)"


def late(alias: str = "") -> str:
    return (
        f"CASE WHEN {alias}order_delivered_customer_date > {alias}order_estimated_delivery_date "
        "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    )


def mean(total: str, count: str) -> str:
    return f"(CAST({total} AS DOUBLE) / NULLIF(CAST({count} AS DOUBLE), 0))"


VIEWS: dict[str, str] = {
    "v_customers": """
        SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id,
               lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
               lower(concat(c_mktsegment, ' ', n_name)) AS customer_city, n_name AS customer_state
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_sellers": """
        SELECT s_suppkey AS seller_id, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
               lower(n_name) AS seller_city, n_name AS seller_state
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END
                   AS order_status,
               o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS order_purchase_timestamp,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate + to_hours((o_orderkey * 31) % 720 + 1) END
                   AS order_delivered_customer_date,
               o_orderdate + to_days(CAST(10 + o_orderkey % 16 AS INT)) AS order_estimated_delivery_date
        FROM orders""",
    "v_order_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
               CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2))
                   AS freight_value
        FROM lineitem""",
    "v_products": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE lower(concat(p_type, '_', p_brand)) END
                   AS product_category_name
        FROM part""",
    "v_translation": """
        SELECT DISTINCT lower(concat(p_type, '_', p_brand)) AS product_category_name,
               concat('en_', lower(p_type), '_', lower(p_brand)) AS product_category_name_english
        FROM part WHERE p_type <> 'PROMO'""",
    "v_payments": """
        SELECT l_orderkey AS order_id,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS payment_sequential,
               CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'boleto' WHEN 'NF' THEN 'voucher'
                    WHEN 'RO' THEN 'debit_card' ELSE 'credit_card' END AS payment_type,
               CAST(l_quantity AS INT) % 10 + 1 AS payment_installments,
               CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2))
                    * CAST(1 + l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS payment_value
        FROM lineitem""",
    "v_reviews": """
        SELECT l_orderkey * 10 + l_linenumber AS review_id, l_orderkey AS order_id,
               1 + CAST(l_quantity AS INT) % 5 AS review_score
        FROM lineitem WHERE l_linenumber = 1""",
    "v_categories": """
        SELECT product_id, COALESCE(product_category_name_english, p.product_category_name, 'unknown') AS category
        FROM v_products p LEFT JOIN v_translation t ON p.product_category_name = t.product_category_name""",
    "v_primary": "SELECT order_id, payment_type FROM v_payments WHERE payment_sequential = 1",
    "v_scores": """
        SELECT order_id, CAST((2 * SUM(review_score) * 100000000 + COUNT(review_score)) // (2 * COUNT(review_score))
                              AS DECIMAL(18,0)) * CAST(0.00000001 AS DECIMAL(9,8)) AS review_score
        FROM v_reviews GROUP BY order_id HAVING COUNT(review_score) > 0
        UNION ALL SELECT order_id, NULL FROM v_reviews GROUP BY order_id HAVING COUNT(review_score) = 0""",
    "v_paid": "SELECT order_id, SUM(payment_value) AS order_total FROM v_payments GROUP BY order_id",
    "v_raw": """
        SELECT c.customer_unique_id, c.customer_state, c.customer_city, o.order_id, o.order_purchase_timestamp,
               o.order_delivered_customer_date, o.order_estimated_delivery_date, i.product_id, i.seller_id, i.price,
               i.freight_value, COALESCE(g.category, 'unknown') AS category, p.payment_type, r.review_score
        FROM v_orders o
        JOIN v_customers c ON o.customer_id = c.customer_id
        JOIN v_order_items i ON o.order_id = i.order_id
        LEFT JOIN v_categories g ON i.product_id = g.product_id
        LEFT JOIN v_primary p ON o.order_id = p.order_id
        LEFT JOIN v_scores r ON o.order_id = r.order_id
        WHERE o.order_status = 'delivered' AND o.order_purchase_timestamp IS NOT NULL""",
    "v_wide": f"""
        SELECT order_id, strftime(order_purchase_timestamp, '%Y-%m') AS month, order_purchase_timestamp,
               order_delivered_customer_date, order_estimated_delivery_date, customer_unique_id,
               customer_state AS state, customer_city AS city, product_id, price, freight_value, category,
               payment_type, review_score, price + freight_value AS item_value,
               {days('order_purchase_timestamp', 'order_delivered_customer_date')} AS delivery_days,
               {late()} AS is_delayed
        FROM v_raw""",
    "v_dirty": """
        SELECT customer_unique_id, customer_state, customer_city, order_id,
               CASE WHEN order_id % 53 = 0 THEN 'not a date'
                    ELSE strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') END AS order_purchase_timestamp,
               order_delivered_customer_date, order_estimated_delivery_date, product_id, seller_id,
               CAST(CASE WHEN product_id % 41 = 0 THEN 0 WHEN product_id % 43 = 0 THEN -price ELSE price END
                    AS DECIMAL(18,2)) AS price,
               CASE WHEN product_id % 47 = 0 THEN -freight_value WHEN product_id % 59 = 0 THEN NULL
                    ELSE freight_value END AS freight_value,
               CASE WHEN product_id % 61 <> 0 THEN category END AS category,
               CASE WHEN order_id % 67 <> 0 THEN payment_type END AS payment_type, review_score
        FROM v_raw""",
    "v_clean": """
        SELECT * FROM v_raw WHERE price > 0
        QUALIFY ROW_NUMBER() OVER (PARTITION BY order_id, product_id, seller_id
                                   ORDER BY price DESC, freight_value ASC NULLS LAST) = 1""",
    "v_clean_orders": """
        SELECT DISTINCT order_id, customer_unique_id, customer_state, customer_city, order_purchase_timestamp,
               order_delivered_customer_date, order_estimated_delivery_date,
               COALESCE(payment_type, 'unknown') AS payment_type, review_score
        FROM v_clean""",
    "v_reference": "SELECT CAST(date_trunc('day', MAX(order_purchase_timestamp)) AS TIMESTAMP) AS d FROM v_clean",
    "v_item_level": """
        SELECT customer_unique_id, SUM(price + freight_value) AS spend, COUNT(product_id) AS total_products,
               COUNT(DISTINCT category) AS distinct_categories, COUNT(DISTINCT seller_id) AS distinct_sellers,
               SUM(freight_value) AS freight
        FROM v_clean GROUP BY customer_unique_id""",
    "v_order_level": f"""
        SELECT customer_unique_id, COUNT(*) AS num_orders, MIN(order_purchase_timestamp) AS first_purchase,
               MAX(order_purchase_timestamp) AS last_purchase,
               {mean(f"SUM({days('order_purchase_timestamp', 'order_delivered_customer_date')})",
                     'COUNT(order_delivered_customer_date)')} AS avg_delivery_days,
               {mean('SUM(review_score)', 'COUNT(review_score)')} AS avg_review_score,
               {mean(f'SUM({late()})', 'COUNT(*)')} AS pct_delayed,
               {mean('SUM(CASE WHEN isodow(order_purchase_timestamp) >= 6 THEN 1 ELSE 0 END)', 'COUNT(*)')}
                   AS weekend_purchase_ratio,
               arg_min(customer_state, (order_purchase_timestamp, order_id)) AS state,
               arg_min(customer_city, (order_purchase_timestamp, order_id)) AS city
        FROM v_clean_orders GROUP BY customer_unique_id""",
    "v_preferred": """
        SELECT customer_unique_id, payment_type AS preferred_payment_method
        FROM (SELECT customer_unique_id, payment_type, COUNT(*) AS n FROM v_clean_orders GROUP BY ALL)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_unique_id ORDER BY n DESC, payment_type) = 1""",
    "v_recency": f"""
        SELECT customer_unique_id, {days('first_purchase', 'd')} AS days_since_first_purchase,
               {days('last_purchase', 'd')} AS days_since_last_purchase,
               {days('first_purchase', 'last_purchase')} AS customer_lifetime_days
        FROM v_order_level, v_reference""",
    "v_features": f"""
        SELECT i.customer_unique_id, {he('spend')} AS total_spend, total_products, distinct_categories,
               distinct_sellers, num_orders, {he('avg_delivery_days')} AS avg_delivery_days,
               {he('avg_review_score')} AS avg_review_score, {he('pct_delayed')} AS pct_delayed,
               {he('weekend_purchase_ratio')} AS weekend_purchase_ratio, state, city, days_since_first_purchase,
               days_since_last_purchase, customer_lifetime_days, preferred_payment_method,
               {he(mean('spend', 'num_orders'))} AS avg_order_value,
               {he(mean('total_products', 'num_orders'))} AS avg_basket_size,
               {he(mean('num_orders', 'GREATEST(days_since_first_purchase, 1)') + ' * 30')} AS purchase_frequency,
               {he(mean('freight', 'GREATEST(CAST(spend AS DOUBLE), 0.01)'))} AS avg_freight_ratio,
               CASE WHEN days_since_last_purchase > 180 THEN 1 ELSE 0 END AS churn
        FROM v_item_level i
        JOIN v_order_level o ON i.customer_unique_id = o.customer_unique_id
        JOIN v_recency r ON i.customer_unique_id = r.customer_unique_id
        JOIN v_preferred p ON i.customer_unique_id = p.customer_unique_id""",
    # A score that both engines compute to the last bit, with many equal values.
    "v_scored": f"""
        SELECT customer_unique_id, churn AS label, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction
        FROM (SELECT customer_unique_id, churn,
                     {he('COALESCE(avg_delivery_days, 0.0) / (COALESCE(avg_delivery_days, 0.0) + 14.0)', 2)} AS score
              FROM v_features)""",
    "v_linear_mean": "SELECT AVG(num_orders) AS m_orders, AVG(pct_delayed) AS m_late, "
    "AVG(avg_basket_size) AS m_basket FROM v_features",
    "v_linear": """
        SELECT customer_unique_id, 0.25 + -0.5 * m_orders + 1.75 * m_late + 0.125 * m_basket AS base_value,
               -0.5 * (num_orders - m_orders) AS num_orders, 1.75 * (pct_delayed - m_late) AS pct_delayed,
               0.125 * (avg_basket_size - m_basket) AS avg_basket_size
        FROM v_features, v_linear_mean""",
}


def with_views(sql: str) -> str:
    """Put the definitions of all views that ``sql`` uses, directly or not, in front of it."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    definitions = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    # A query with definitions of its own gets the views in front of them.
    return f"WITH {definitions}" + (f",\n{sql[5:]}" if sql.startswith("WITH ") else f"\n{sql}")
