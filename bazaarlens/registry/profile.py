from __future__ import annotations

from bazaarlens.operators import profile, quality
from bazaarlens.operators.features import FEATURE_COLUMNS
from bazaarlens.registry.core import register, settled
from bazaarlens.registry.views import he, mean

_LABEL = "CASE churn WHEN 0 THEN 'Active' WHEN 1 THEN 'Churned' END"

register(
    "e01_dataset_summary",
    lambda s: settled(profile.dataset_summary(s.features)),
    f"""SELECT COUNT(*) AS customers, CAST(SUM(churn) AS BIGINT) AS churned,
               {he(mean('SUM(churn)', 'COUNT(*)') + ' * 100')} AS churned_pct,
               CAST(COUNT(*) - SUM(churn) AS BIGINT) AS active,
               {he('100 - ' + mean('SUM(churn)', 'COUNT(*)') + ' * 100')} AS active_pct,
               {he('AVG(total_spend)')} AS avg_spend, {he('AVG(num_orders)')} AS avg_orders,
               {he('AVG(avg_review_score)')} AS avg_review, {he('AVG(avg_delivery_days)')} AS avg_delivery_days
        FROM v_features""",
)
register(
    "e02_missing_values",
    lambda s: quality.missing_values(s.features),
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM v_features"
        for c in FEATURE_COLUMNS
    )
    + ") WHERE null_count > 0",
)
register(
    "e03_churn_split",
    lambda s: profile.churn_split(s.features),
    f"SELECT {_LABEL} AS label, COUNT(*) AS customers FROM v_features GROUP BY 1",
)
register(
    "e04_review_distribution",
    lambda s: profile.review_distribution(s.features),
    """SELECT CAST(round_even(avg_review_score, 0) AS INT) AS score, COUNT(*) AS customers FROM v_features
       WHERE avg_review_score IS NOT NULL GROUP BY 1""",
)
for _bins in (80, 60):
    register(
        f"e05_spend_histogram_{_bins}",
        lambda s, bins=_bins: settled(profile.spend_histogram(s.stored_features, bins)),
        f"""WITH r AS (SELECT MIN(total_spend) AS lo, (MAX(total_spend) - MIN(total_spend)) / {_bins} AS w
                       FROM v_features),
                 b AS (SELECT CAST(LEAST(floor((total_spend - lo) / w), {_bins - 1}) AS INT) AS bin, lo, w
                       FROM v_features, r)
            SELECT bin, {he('lo + bin * w')} AS bin_start, {he('lo + (bin + 1) * w')} AS bin_end,
                   COUNT(*) AS customers
            FROM b GROUP BY bin, lo, w""",
    )
register(
    "e06_orders_distribution",
    lambda s: profile.orders_distribution(s.features),
    "SELECT num_orders, COUNT(*) AS customers FROM v_features GROUP BY 1 ORDER BY 1 LIMIT 15",
)
register(
    "e07_common_order_counts",
    lambda s: profile.common_order_counts(s.features),
    "SELECT num_orders, COUNT(*) AS customers FROM v_features GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
register(
    "e08_churn_by_state",
    lambda s: profile.churn_by_state(s.features),
    f"""SELECT state, {he(mean('SUM(churn)', 'COUNT(churn)') + ' * 100', 1)} AS churn_rate_pct FROM v_features
        WHERE state IS NOT NULL GROUP BY state ORDER BY 2 DESC, 1 LIMIT 15""",
)


def _correlations(columns) -> str:
    sums = ", ".join(
        f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r_{i}_{j}"
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i <= j
    )
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {he(f'r_{min(i, j)}_{max(i, j)}', 2)} AS r FROM c"
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    )
    return f"WITH c AS (SELECT {sums} FROM v_features) {rows}"


register(
    "e09_correlation_matrix",
    lambda s: profile.correlation_matrix(s.stored_features),
    _correlations(profile.CORRELATION_COLUMNS),
)
register(
    "e10_short_correlation_matrix",
    lambda s: profile.correlation_matrix(s.stored_features, profile.SHORT_CORRELATION_COLUMNS),
    _correlations(profile.SHORT_CORRELATION_COLUMNS),
)
register(
    "e11_buyer_types",
    lambda s: settled(profile.buyer_types(s.features)),
    f"""WITH c AS (SELECT COUNT(*) FILTER (WHERE num_orders = 1) AS a, COUNT(*) FILTER (WHERE num_orders > 1) AS b
                   FROM v_features)
        SELECT 'Single Purchase' AS segment, a AS customers, {he(mean('a', 'a + b') + ' * 100')} AS pct_of_base FROM c
        UNION ALL
        SELECT 'Repeat Buyers', b, {he(mean('b', 'a + b') + ' * 100')} FROM c""",
)
for _name, _column in (("e12_review_by_churn", "avg_review_score"), ("e13_delay_by_churn", "pct_delayed")):
    register(
        _name,
        lambda s, column=_column: settled(profile.mean_by_churn(s.features, column)),
        f"SELECT churn, {_LABEL} AS label, {he(f'AVG({_column})')} AS {_column} FROM v_features GROUP BY churn",
    )
register(
    "e14_customer_sample",
    lambda s: profile.spend_orders_sample(s.features),
    f"""SELECT customer_unique_id, total_spend, num_orders, {_LABEL} AS status FROM v_features
        ORDER BY md5(concat_ws(':', 42, customer_unique_id)), customer_unique_id LIMIT 3000""",
)
register(
    "e15_customer_summary",
    lambda s: profile.customer_summary(s.features),
    f"SELECT {', '.join(profile.SUMMARY_COLUMNS)} FROM v_features",
)
register(
    "e16_customer_choices",
    lambda s: profile.customer_choices(s.features),
    "SELECT customer_unique_id FROM v_features ORDER BY 1 LIMIT 300",
)
_FRACTIONS = {"total_spend", "avg_order_value", "avg_review_score", "pct_delayed", "avg_delivery_days"}
register(
    "e16_customer_profiles",
    lambda s: profile.profile_text(s.features),
    "SELECT customer_unique_id, "
    + ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN printf('%.2f', {he(c, 2)}) END AS {c}"
        if c in _FRACTIONS
        else f"CAST({c} AS VARCHAR) AS {c}"
        for c in profile.PROFILE_COLUMNS
    )
    + " FROM v_features",
)


# The same with limits that the test tables reach.
register(
    "e06_orders_distribution_short",
    lambda s: profile.orders_distribution(s.features, 4),
    "SELECT num_orders, COUNT(*) AS customers FROM v_features GROUP BY 1 ORDER BY 1 LIMIT 4",
)
register(
    "e07_common_order_counts_short",
    lambda s: profile.common_order_counts(s.features, 4),
    "SELECT num_orders, COUNT(*) AS customers FROM v_features GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4",
)
register(
    "e14_customer_sample_500",
    lambda s: profile.spend_orders_sample(s.features, 500),
    f"""SELECT customer_unique_id, total_spend, num_orders, {_LABEL} AS status FROM v_features
        ORDER BY md5(concat_ws(':', 42, customer_unique_id)), customer_unique_id LIMIT 500""",
)
