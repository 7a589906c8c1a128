from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import display_number
from bazaarlens.operators import kpi, product
from bazaarlens.registry.core import Source, register, settled
from bazaarlens.registry.views import he, mean

_INPUT = ("order_id", "customer_unique_id", "item_value", "review_score", "delivery_days", "is_delayed")
_CONTEXT_INPUT = (*_INPUT, "category", "state", "payment_type")

_AOV = mean("SUM(item_value)", "COUNT(DISTINCT order_id)")
_REVIEW = mean("SUM(review_score)", "COUNT(review_score)")
_CHURN = "(SELECT AVG(churn) * 100 FROM v_features)"
_REPEAT = "(SELECT COUNT(*) FILTER (WHERE num_orders > 1) / CAST(COUNT(*) AS DOUBLE) * 100 FROM v_features)"
_LATE = f"{mean('SUM(is_delayed)', 'COUNT(*)')} * 100"
_TRAVEL = mean("SUM(delivery_days)", "COUNT(delivery_days)")

register(
    "k01_executive_kpis",
    lambda s: settled(kpi.executive_kpis(s.items(*_INPUT), s.features)),
    f"""SELECT CAST(SUM(item_value) AS DOUBLE) AS total_revenue, COUNT(DISTINCT order_id) AS total_orders,
               COUNT(DISTINCT customer_unique_id) AS customers, {he(_AOV)} AS avg_order_value,
               {he(_REVIEW)} AS avg_review_item_weighted,
               {he(f"(SELECT {mean('SUM(r)', 'COUNT(r)')} FROM (SELECT MAX(review_score) AS r FROM v_wide GROUP BY order_id))")}
                   AS avg_review_per_order,
               {he(_CHURN)} AS churn_rate_pct
        FROM v_wide""",
)
register(
    "k02_report_kpis",
    lambda s: settled(kpi.report_kpis(s.items(*_INPUT), s.features)),
    f"""SELECT CAST(SUM(item_value) AS DOUBLE) AS total_revenue, COUNT(DISTINCT order_id) AS total_orders,
               COUNT(DISTINCT customer_unique_id) AS unique_customers, {he(_AOV)} AS avg_order_value,
               {he(_REVIEW)} AS avg_review_item_weighted, {he(_CHURN)} AS churn_rate_pct,
               {he(_REPEAT)} AS repeat_rate_pct, {he(_LATE)} AS late_pct_item_weighted
        FROM v_wide""",
)


def _scalar(name: str, expression: str) -> str:
    digits = kpi.CONTEXT_SCALARS[name]
    table = "" if expression.startswith("(SELECT") else "FROM v_wide"
    return f"SELECT '{name}' AS metric, CAST(NULL AS VARCHAR) AS key, {he(expression, digits)} AS value {table}"


def _listed(name: str, key: str, value: str, order: str) -> str:
    return f"""SELECT '{name}' AS metric, {key} AS key, {he('value', 2)} AS value FROM (
        SELECT {key}, {value} AS value FROM v_wide WHERE {key} IS NOT NULL GROUP BY {key} {order})"""


_CONTEXT_SQL = " UNION ALL ".join(
    [
        _scalar("total_revenue_BRL", "SUM(item_value)"),
        _scalar("total_orders", "COUNT(DISTINCT order_id)"),
        _scalar("total_unique_customers", "COUNT(DISTINCT customer_unique_id)"),
        _scalar("avg_order_value_BRL", _AOV),
        _scalar("avg_review_score_out_of_5", _REVIEW),
        _scalar("churn_rate_percent", _CHURN),
        _scalar("repeat_customer_rate_percent", _REPEAT),
        _scalar("avg_delivery_days", _TRAVEL),
        _scalar("pct_orders_delayed", _LATE),
        _listed("top_5_categories_by_revenue", "category", "SUM(item_value)", "ORDER BY 2 DESC, 1 LIMIT 5"),
        _listed("bottom_5_categories_by_revenue", "category", "SUM(item_value)", "ORDER BY 2, 1 LIMIT 5"),
        _listed("top_5_states_by_revenue", "state", "SUM(item_value)", "ORDER BY 2 DESC, 1 LIMIT 5"),
        _listed("payment_method_order_share", "payment_type", "COUNT(DISTINCT order_id)", ""),
    ]
)
register(
    "k03_business_context",
    lambda s: kpi.business_context_entries(s.items(*_CONTEXT_INPUT), s.features),
    _CONTEXT_SQL,
)
register("k03_business_context_row", lambda s: kpi.business_context(s.items(*_CONTEXT_INPUT), s.features))


def _context_cells(s: Source) -> DataFrame:
    """The row of scalars and maps, taken apart again."""
    row = kpi.business_context(s.items(*_CONTEXT_INPUT), s.features)
    scalars = [
        F.struct(F.lit(c).alias("metric"), F.lit(None).cast("string").alias("key"), F.col(c).cast("double").alias("value"))
        for c in kpi.CONTEXT_SCALARS
    ]

    def entries(name: str):
        as_cell = lambda e: F.struct(F.lit(name).alias("metric"), e["key"].alias("key"), e["value"].alias("value"))
        return F.transform(F.map_entries(name), as_cell)

    listed = [entries(c) for c in kpi.CONTEXT_MAPS]
    return row.select(F.inline(F.concat(F.array(*scalars), *listed)))


register("k03_business_context_cells", _context_cells, _CONTEXT_SQL)
register(
    "k04_best_and_worst_month",
    lambda s: kpi.best_and_worst_month(s.items("month", "item_value")),
    """WITH m AS (SELECT month, SUM(item_value) AS v FROM v_wide WHERE month IS NOT NULL GROUP BY month)
       SELECT (SELECT month FROM m ORDER BY v DESC, month LIMIT 1) AS best_month,
              CAST((SELECT MAX(v) FROM m) AS DOUBLE) AS best_revenue,
              (SELECT month FROM m ORDER BY v, month LIMIT 1) AS worst_month,
              CAST((SELECT MIN(v) FROM m) AS DOUBLE) AS worst_revenue""",
)


def _display(value: str, currency: bool) -> str:
    sign = "R$ " if currency else ""
    small = f"printf('{sign}%.2f', {he(value, 2)})" if currency else f"printf('%.0f', round_even({value}, 0))"
    return f"""CASE WHEN {value} >= 1000000 THEN printf('{sign}%.2fM', {he(f'{value} / 1e6', 2)})
                    WHEN {value} >= 1000 THEN printf('{sign}%.1fk', {he(f'{value} / 1e3', 1)}) ELSE {small} END"""


register(
    "k05_number_text",
    lambda s: product.category_performance(
        s.items("category", "order_id", "item_value", "review_score")
    ).select(
        "category",
        display_number(F.col("revenue"), currency=True).alias("revenue"),
        display_number(F.col("orders")).alias("orders"),
        display_number(F.col("orders") * 100).alias("many_orders"),
        display_number(F.col("avg_review") * 250, currency=True).alias("small_amount"),
    ),
    f"""SELECT category, {_display('revenue', True)} AS revenue, {_display('orders', False)} AS orders,
               {_display('(orders * 100)', False)} AS many_orders, {_display('(avg_review * 250)', True)} AS small_amount
        FROM (SELECT category, CAST(SUM(item_value) AS DOUBLE) AS revenue,
                     CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS orders, {_REVIEW} AS avg_review
              FROM v_wide GROUP BY category)""",
)
register(
    "k05_display_kpis",
    lambda s: kpi.display_kpis(s.items(*_INPUT), s.features),
    f"""SELECT {_display('revenue', True)} AS total_revenue, {_display('orders', False)} AS total_orders,
               {_display('customers', False)} AS customers, {_display('aov', True)} AS avg_order_value,
               printf('%.2f / 5', {he('review', 2)}) AS avg_review,
               concat(printf('%.1f', {he('churn', 1)}), '%') AS churn_rate
        FROM (SELECT CAST(SUM(item_value) AS DOUBLE) AS revenue, CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS orders,
                     CAST(COUNT(DISTINCT customer_unique_id) AS DOUBLE) AS customers, {_AOV} AS aov,
                     {_REVIEW} AS review, {_CHURN} AS churn
              FROM v_wide)""",
)
