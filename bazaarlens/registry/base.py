from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import mean_of
from bazaarlens.operators import base, cleaning, filters
from bazaarlens.operators.filters import Filters
from bazaarlens.registry.core import Source, register, settled
from bazaarlens.registry.views import days, he, late, mean

_WIDE = ", ".join(he(c) + f" AS {c}" if c == "review_score" else c for c in base.WIDE_COLUMNS)
_RAW = ", ".join(he(c) + f" AS {c}" if c == "review_score" else c for c in base.FEATURE_INPUT_COLUMNS)
_MONEY = ("price", "freight_value", "item_value")


def _plain(text: str) -> str:
    """Money as double in the result, whatever the engine's decimal type is called."""
    for name in _MONEY:
        text = text.replace(f" {name},", f" CAST({name} AS DOUBLE) AS {name},")
    return text


def _doubles(df: DataFrame) -> DataFrame:
    exact = [c for c in (*_MONEY, "review_score") if c in df.columns]
    return settled(df.withColumns({c: F.col(c).cast("double") for c in exact}))


register("b01_order_items_wide", lambda s: _doubles(s.items()), f"SELECT {_plain(_WIDE + ',').rstrip(',')} FROM v_wide")
register(
    "b02_primary_payment",
    lambda s: base.primary_payments(s.tables.payments),
    "SELECT order_id, payment_type FROM v_primary",
)
register(
    "b03_review_score",
    lambda s: _doubles(base.review_scores(s.tables.reviews)),
    f"SELECT order_id, {he('review_score')} AS review_score FROM v_scores",
)
register(
    "b04_category",
    lambda s: base.product_categories(s.tables.products, s.tables.product_category_translation),
    "SELECT product_id, category FROM v_categories",
)
register(
    "b05_month_key",
    lambda s: s.items("order_id", "product_id", "month"),
    "SELECT order_id, product_id, month FROM v_wide",
)
register(
    "b06_item_value",
    lambda s: _doubles(s.items("order_id", "product_id", "item_value")),
    "SELECT order_id, product_id, CAST(item_value AS DOUBLE) AS item_value FROM v_wide",
)
register(
    "b07_delivery_days",
    lambda s: s.items("order_id", "product_id", "delivery_days"),
    f"SELECT order_id, product_id, {days('order_purchase_timestamp', 'order_delivered_customer_date')} "
    "AS delivery_days FROM v_raw",
)
register(
    "b08_is_delayed",
    lambda s: s.items("order_id", "product_id", "is_delayed"),
    f"SELECT order_id, product_id, {late()} AS is_delayed FROM v_raw",
)
register("b09_feature_input", lambda s: _doubles(s.raw), f"SELECT {_plain(_RAW + ',').rstrip(',')} FROM v_raw")
register(
    "b10_delivered_orders",
    lambda s: base.with_status(s.tables.orders),
    "SELECT * FROM v_orders WHERE order_status = 'delivered'",
)


def dirty_rows(raw: DataFrame) -> DataFrame:
    """The base rows with faults that every cleaning rule has to deal with, placed by key."""
    product, order = F.col("product_id"), F.col("order_id")
    return raw.withColumns(
        {
            "order_purchase_timestamp": F.when(order % 53 == 0, "not a date").otherwise(
                F.col("order_purchase_timestamp").cast("string")
            ),
            "price": F.when(product % 41 == 0, F.lit(0).cast("decimal(18,2)"))
            .when(product % 43 == 0, -F.col("price"))
            .otherwise(F.col("price")),
            "freight_value": F.when(product % 47 == 0, -F.col("freight_value")).when(
                product % 59 != 0, F.col("freight_value")
            ),
            "category": F.when(product % 61 != 0, F.col("category")),
            "payment_type": F.when(order % 67 != 0, F.col("payment_type")),
        }
    )


def _dirty(s: Source) -> DataFrame:
    return dirty_rows(s.raw)


_LINE = "order_id, product_id, seller_id"
_PARSED = "TRY_CAST(order_purchase_timestamp AS TIMESTAMP)"
_SELLER_KEY = ("order_id", "seller_id")


def _seller_order():
    return [*cleaning.line_order(), F.col("product_id")]


register(
    "c01_parse_timestamps",
    lambda s: cleaning.parse_timestamps(_dirty(s)).select(
        "order_id", "product_id", "seller_id", "order_purchase_timestamp"
    ),
    f"SELECT {_LINE}, {_PARSED} AS order_purchase_timestamp FROM v_dirty",
)
register(
    "c02_drop_undated",
    lambda s: cleaning.drop_undated(cleaning.parse_timestamps(_dirty(s))).select(
        "order_id", "product_id", "seller_id", "order_purchase_timestamp"
    ),
    f"SELECT {_LINE}, {_PARSED} AS order_purchase_timestamp FROM v_dirty WHERE {_PARSED} IS NOT NULL",
)
register(
    "c03_drop_repeated_lines",
    lambda s: _doubles(
        cleaning.drop_repeated_lines(s.raw).select("order_id", "product_id", "seller_id", "price", "freight_value")
    ),
    f"SELECT {_LINE}, CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value FROM v_raw "
    f"QUALIFY ROW_NUMBER() OVER (PARTITION BY {_LINE} ORDER BY price DESC, freight_value NULLS LAST) = 1",
)
register(
    "c03_first_line_per_seller",
    lambda s: _doubles(
        cleaning.drop_repeated_lines(_dirty(s), _SELLER_KEY, _seller_order()).select(
            "order_id", "product_id", "seller_id", "price", "freight_value"
        )
    ),
    f"SELECT {_LINE}, CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value FROM v_dirty "
    "QUALIFY ROW_NUMBER() OVER (PARTITION BY order_id, seller_id "
    "ORDER BY price DESC, freight_value NULLS LAST, product_id) = 1",
)
register(
    "c04_keep_priced",
    lambda s: _doubles(cleaning.keep_priced(_dirty(s)).select("order_id", "product_id", "seller_id", "price")),
    f"SELECT {_LINE}, CAST(price AS DOUBLE) AS price FROM v_dirty WHERE price > 0",
)
register(
    "c05_clip_freight",
    lambda s: _doubles(cleaning.clip_freight(_dirty(s)).select("order_id", "product_id", "seller_id", "freight_value")),
    f"SELECT {_LINE}, CAST(CASE WHEN freight_value < 0 THEN 0 ELSE freight_value END AS DOUBLE) AS freight_value "
    "FROM v_dirty",
)
register(
    "c06_fill_category",
    lambda s: cleaning.fill_category(_dirty(s)).select("order_id", "product_id", "seller_id", "category"),
    f"SELECT {_LINE}, COALESCE(category, 'unknown') AS category FROM v_dirty",
)
register(
    "c07_fill_payment_type",
    lambda s: cleaning.fill_payment_type(_dirty(s)).select("order_id", "product_id", "seller_id", "payment_type"),
    f"SELECT {_LINE}, COALESCE(payment_type, 'unknown') AS payment_type FROM v_dirty",
)
register(
    "c08_review_nulls_skipped",
    lambda s: settled(
        s.clean.groupBy("category").agg(
            F.count("*").alias("items"),
            F.count("review_score").alias("reviewed"),
            mean_of(F.sum("review_score"), F.count("review_score")).alias("avg_review"),
        )
    ),
    "SELECT category, COUNT(*) AS items, COUNT(review_score) AS reviewed, "
    f"{he(mean('SUM(review_score)', 'COUNT(review_score)'))} AS avg_review FROM v_clean GROUP BY category",
)
register(
    "c09_cleaning_audit",
    lambda s: settled(cleaning.cleaning_audit(_dirty(s), _SELLER_KEY)),
    f"""SELECT n AS rows_in, n - dated AS dropped_undated, dated - lines AS dropped_repeated,
               lines - rows_out AS dropped_unpriced, rows_out, {he('(n - rows_out) / CAST(n AS DOUBLE) * 100')} AS dropped_pct
        FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE {_PARSED} IS NOT NULL) AS dated FROM v_dirty),
             (SELECT COUNT(*) AS lines, COUNT(*) FILTER (WHERE price > 0) AS rows_out
              FROM (SELECT MAX(price) AS price FROM v_dirty WHERE {_PARSED} IS NOT NULL GROUP BY order_id, seller_id))""",
)
register(
    "c09_clean_items",
    lambda s: _doubles(s.clean),
    f"SELECT {_plain(_RAW + ',').rstrip(',')} FROM (SELECT * REPLACE (COALESCE(payment_type, 'unknown') AS payment_type) "
    "FROM v_clean)",
)
register(
    "c09_clean_dirty_rows",
    lambda s: _doubles(cleaning.clean(_dirty(s))).select(
        "order_id", "product_id", "seller_id", "order_purchase_timestamp", "price", "freight_value", "category",
        "payment_type",
    ),
    f"""SELECT {_LINE}, {_PARSED} AS order_purchase_timestamp, CAST(price AS DOUBLE) AS price,
               CAST(CASE WHEN freight_value < 0 THEN 0 ELSE freight_value END AS DOUBLE) AS freight_value,
               COALESCE(category, 'unknown') AS category, COALESCE(payment_type, 'unknown') AS payment_type
        FROM (SELECT * FROM v_dirty WHERE {_PARSED} IS NOT NULL
              QUALIFY ROW_NUMBER() OVER (PARTITION BY {_LINE} ORDER BY price DESC, freight_value NULLS LAST) = 1)
        WHERE price > 0""",
)

CHOSEN = Filters(
    date_range=(date(1996, 3, 1), date(1998, 2, 28)),
    states=("NATION_1", "NATION_3", "NATION_7", "NATION_11", "NATION_19"),
    payment_types=("boleto", "credit_card"),
)
FILTERED = ("order_id", "product_id", *filters.FILTER_COLUMNS)
_FILTERED_SQL = f"SELECT {', '.join(FILTERED)} FROM v_wide WHERE "
_DATES_SQL = "CAST(order_purchase_timestamp AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'"

register(
    "c10_date_filter",
    lambda s: filters.apply_filters(s.items(*FILTERED), Filters(date_range=CHOSEN.date_range)),
    _FILTERED_SQL + _DATES_SQL,
)
register(
    "c11_membership_filter",
    lambda s: filters.apply_filters(s.items(*FILTERED), CHOSEN),
    _FILTERED_SQL
    + _DATES_SQL
    + f" AND state IN ({', '.join(repr(x) for x in CHOSEN.states)})"
    + f" AND payment_type IN ({', '.join(repr(x) for x in CHOSEN.payment_types)})",
)
register(
    "c12_date_bounds",
    lambda s: filters.date_bounds(s.items("order_purchase_timestamp")),
    "SELECT CAST(MIN(order_purchase_timestamp) AS DATE) AS min_date, "
    "CAST(MAX(order_purchase_timestamp) AS DATE) AS max_date FROM v_wide",
)
register(
    "c12_filter_options",
    lambda s: filters.all_options(s.items("state", "category", "payment_type")),
    " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS filter, {c} AS value FROM v_wide WHERE {c} IS NOT NULL"
        for c in ("state", "category", "payment_type")
    ),
)
