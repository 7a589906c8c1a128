from __future__ import annotations

from datetime import date
from decimal import Decimal

import rows
from pyspark.sql import functions as F

from bazaarlens.sources.tables import CommerceTables
from bazaarlens.operators import base, cleaning, filters, quality
from bazaarlens.operators.filters import Filters


def shop(spark):
    return rows.tables(
        spark,
        customers=[rows.customer("a"), rows.customer("b")],
        products=[
            {"product_id": "p", "product_category_name": "livros"},
            {"product_id": "q", "product_category_name": "sem_nome"},
            {"product_id": "n", "product_category_name": None},
        ],
        product_category_translation=[
            {"product_category_name": "livros", "product_category_name_english": "books"}
        ],
        orders=[
            rows.order("o1", "a", "2020-01-04T23:00", "2020-01-06T01:00", "2020-01-05"),
            rows.order("o2", "a", "2020-01-05T10:00"),
            rows.order("o3", "b", None),
            rows.order("o4", "b", "2020-01-06T10:00", status="shipped"),
            rows.order("o5", "b", "2020-01-06T10:00", "2020-01-06T09:00"),
        ],
        order_items=[
            rows.item("o1", 1, "p", price=10, freight=-3),
            rows.item("o1", 2, "p", price=10, freight=-3),
            rows.item("o1", 3, "q", price=5),
            rows.item("o2", 1, "n", price=0),
            rows.item("o3", 1),
            rows.item("o4", 1),
            rows.item("o5", 1, "gone", price=7, freight=None),
        ],
        payments=[rows.payment("o1", "voucher", number=2), rows.payment("o1", "boleto")],
        reviews=[rows.review("o1", 5, "r1"), rows.review("o1", 2, "r2")],
    )


def test_wide_items_keep_repeats_and_nulls(spark):
    wide = rows.as_dicts(base.order_items_wide(shop(spark)))
    assert sorted(r["order_id"] for r in wide) == ["o1", "o1", "o1", "o2", "o3", "o5"]
    first = next(r for r in wide if r["product_id"] == "p")
    assert first["category"] == "books" and first["payment_type"] == "boleto"
    assert first["review_score"] == 3.5 and first["month"] == "2020-01"
    assert first["delivery_days"] == 1 and first["is_delayed"] == 1.0
    assert first["item_value"] == Decimal("7.00")
    other = {r["order_id"]: r for r in wide if r["order_id"] != "o1"}
    assert other["o2"]["category"] == "unknown" and other["o2"]["payment_type"] is None
    assert other["o2"]["delivery_days"] is None and other["o2"]["is_delayed"] == 0.0
    assert other["o5"]["category"] == "unknown" and other["o5"]["delivery_days"] == -1
    assert other["o3"]["month"] is None
    assert next(r for r in wide if r["product_id"] == "q")["category"] == "sem_nome"


def test_pruned_columns_equal_full_ones(spark):
    tables = shop(spark)
    for columns in (("order_id", "item_value"), ("category", "state"), ("payment_type", "review_score", "month")):
        full = base.order_items_wide(tables).select(*columns)
        assert sorted(map(str, base.order_items_wide(tables, columns).collect())) == sorted(map(str, full.collect()))


def test_clean_items(spark):
    tables = shop(spark)
    clean = rows.as_dicts(cleaning.clean_items(tables))
    assert sorted((r["order_id"], r["product_id"]) for r in clean) == [("o1", "p"), ("o1", "q"), ("o5", "gone")]
    line = {r["product_id"]: r for r in clean}
    assert line["p"]["freight_value"] == 0 and line["gone"]["freight_value"] is None
    assert line["gone"]["payment_type"] == "unknown" and line["gone"]["review_score"] is None
    generic = cleaning.clean(base.feature_input(tables))
    assert sorted(map(str, generic.select(*sorted(generic.columns)).collect())) == sorted(
        map(str, cleaning.clean_items(tables).select(*sorted(generic.columns)).collect())
    )
    orders = cleaning.clean_orders(tables).select("order_id").collect()
    assert sorted(r[0] for r in orders) == ["o1", "o5"]


def test_bad_timestamp_is_dropped(spark):
    raw = base.feature_input(shop(spark)).withColumn(
        "order_purchase_timestamp",
        F.when(F.col("order_id") == "o5", "not a date").otherwise(F.col("order_purchase_timestamp").cast("string")),
    )
    assert {r["order_id"] for r in cleaning.clean(raw).collect()} == {"o1"}
    audit = cleaning.cleaning_audit(raw).first().asDict()
    assert audit == {
        "rows_in": 5,
        "dropped_undated": 1,
        "dropped_repeated": 1,
        "dropped_unpriced": 1,
        "rows_out": 2,
        "dropped_pct": 60.0,
    }


def test_first_line_is_dropped_whole_when_it_is_free(spark):
    tables = rows.tables(
        spark,
        customers=[rows.customer("a")],
        orders=[rows.order("o", "a", "2020-01-01")],
        order_items=[rows.item("o", 1, price=-2), rows.item("o", 2, price=4, freight=9), rows.item("o", 3, price=4, freight=2)],
    )
    assert [(r["price"], r["freight_value"]) for r in cleaning.clean_items(tables).collect()] == [(4, 2)]


def test_filters(spark):
    wide = base.order_items_wide(shop(spark))
    day = date(2020, 1, 4)

    def orders(chosen):
        return sorted({r["order_id"] for r in filters.apply_filters(wide, chosen).collect()})

    assert orders(Filters()) == ["o1", "o2", "o3", "o5"]
    assert orders(Filters(date_range=[day])) == ["o1", "o2", "o3", "o5"]
    assert orders(Filters(date_range=[day, day])) == ["o1"]
    assert orders(Filters(date_range=[day, date(2020, 1, 5)])) == ["o1", "o2"]
    assert orders(Filters(payment_types=["boleto", "voucher"])) == ["o1"]
    assert orders(Filters(states=["none"])) == []
    assert [r["value"] for r in filters.options(wide, "payment_type").collect()] == ["boleto"]
    assert filters.date_bounds(wide).first() == (date(2020, 1, 4), date(2020, 1, 6))


def test_contract_checks(spark):
    tables = shop(spark)
    broken = tables.replaced(
        orders=tables.orders.union(tables.orders.filter("order_id = 'o1'")),
        order_items=tables.order_items.union(
            rows.table(spark, "order_items", [rows.item("lost", 1), rows.item("lost", 1), rows.item("o1", 9, price=None)])
        ),
    )
    duplicates = rows.by(quality.duplicate_key_counts(broken), "table_name")
    assert duplicates["orders"]["surplus_rows"] == 1 and duplicates["order_items"]["duplicate_keys"] == 1
    lost = {(r["table_name"], r["parent_table"]): r["orphan_rows"] for r in quality.orphan_counts(broken).collect()}
    assert lost["order_items", "orders"] == 2
    assert lost["order_items", "products"] == 1
    assert lost["products", "product_category_translation"] == 1
    assert quality.orphans(broken, "order_items", "orders").count() == 2
    missing = {(r["table_name"], r["column_name"]): r["null_count"] for r in quality.missing_mandatory(broken).collect()}
    assert missing["order_items", "price"] == 1 and missing["order_items", "freight_value"] == 1
    assert rows.by(quality.row_counts(broken), "table_name")["orders"]["row_count"] == 6


def test_what_cannot_be_checked_is_said(spark):
    tables = CommerceTables(orders=shop(spark).orders.select("order_id"), order_items=shop(spark).order_items)
    missing = {(r["table_name"], r["column_name"]): (r["null_count"], r["status"]) for r in quality.missing_mandatory(tables).collect()}
    assert missing["orders", "customer_id"] == (None, "absent") and missing["orders", "order_id"] == (0, "checked")
    lost = {(r["table_name"], r["parent_table"]): (r["orphan_rows"], r["status"]) for r in quality.orphan_counts(tables).collect()}
    assert lost["order_items", "products"] == (None, "absent") and lost["orders", "customers"] == (None, "absent")
    assert lost["order_items", "orders"][1] == "checked"


def test_hot_line_is_trimmed_before_the_shuffle(spark):
    """One line holds most rows: every map task sends one row of it."""
    same = (F.col("id") % 1).cast("string")
    hot = spark.range(0, 20000, numPartitions=4).select(
        same.alias("order_id"),
        same.alias("product_id"),
        same.alias("seller_id"),
        (F.col("id") % 977).cast("decimal(18,2)").alias("price"),
        F.lit(1).cast("decimal(18,2)").alias("freight_value"),
    )
    first = cleaning.drop_repeated_lines(hot)
    assert [r["price"] for r in first.collect()] == [976]
    plan = first._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange")
    assert "WindowGroupLimit" in plan[exchange:] and "WindowGroupLimit" in plan[:exchange]
