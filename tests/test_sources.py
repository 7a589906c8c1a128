from __future__ import annotations

import rows
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import reports
from bazaarlens.sources import artifacts
from bazaarlens.sources.catalog import CATALOG
from bazaarlens.sources.tables import (
    CommerceTables,
    load_saved_tables,
    read_csv_table,
    read_csv_tables,
    read_tables,
    save_bucketed_tables,
    unparsed_values,
    write_tables,
)


@pytest.fixture()
def csv_folder(tmp_path):
    (tmp_path / "shop_orders_dataset.csv").write_text(
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,"
        "order_delivered_customer_date,order_estimated_delivery_date\n"
        "o1,c1,delivered,2018-01-02 03:04:05,,,2018-01-09 00:00:00,2018-01-08 00:00:00\n"
        "o2,c1,delivered,not a date,,,,2018-01-08 00:00:00\n"
    )
    (tmp_path / "shop_order_reviews_dataset.csv").write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,"
        "review_answer_timestamp\n"
        'r1,o1,5,"so ""good""","two\nlines, one comma",2018-01-10 00:00:00,\n'
        "r2,o2,1,,,2018-01-10 00:00:00,\n"
    )
    (tmp_path / "shop_customers_dataset.csv").write_text(
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,u1,01409,sp,SP\n"
    )
    (tmp_path / "shop_order_payments_dataset.csv").write_text(
        "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,boleto,1,99.33\n"
        "o1,2,voucher,1,0.67\n"
    )
    return str(tmp_path)


def test_csv_tables(spark, csv_folder):
    tables = read_csv_tables(spark, csv_folder)
    assert set(tables.present()) == {"customers", "orders", "payments", "reviews"}
    assert tables.products is None
    orders = rows.by(tables.orders, "order_id")
    assert str(orders["o1"]["order_purchase_timestamp"]) == "2018-01-02 03:04:05"
    assert orders["o2"]["order_purchase_timestamp"] is None
    reviews = rows.by(tables.reviews, "review_id")
    assert reviews["r1"]["review_comment_title"] == 'so "good"'
    assert reviews["r1"]["review_comment_message"] == "two\nlines, one comma"
    assert tables.customers.first()["customer_zip_code_prefix"] == "01409"
    for name, df in tables.present().items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in CATALOG[name].schema]


def test_file_names_can_be_given(spark, csv_folder, tmp_path):
    (tmp_path / "vendors.csv").write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,sp,SP\n")
    tables = read_csv_tables(spark, csv_folder, {"orders": "absent.csv", "sellers": "vendors.csv"})
    assert tables.orders is None and tables.sellers.count() == 1


def test_parquet_round_trip_and_views(spark, csv_folder, tmp_path):
    loaded = read_csv_tables(spark, csv_folder)
    folder = str(tmp_path / "tables")
    write_tables(loaded, folder)
    write_tables(loaded, folder)
    stored = read_tables(spark, folder)
    assert set(stored.present()) == set(loaded.present()) and stored.reviews.count() == 2
    stored.register_views()
    assert spark.sql("SELECT sum(payment_value) FROM payments").first()[0] == 100
    assert [tuple(r) for r in reports.monthly_revenue(stored).collect()] == [("2018-01", 1, 100.0)]


def test_bucketed_tables_join_without_a_shuffle(spark, csv_folder, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed_shop")
    save_bucketed_tables(read_csv_tables(spark, csv_folder), "bucketed_shop", str(tmp_path / "b"), 4)
    stored = load_saved_tables(spark, "bucketed_shop")
    paid = stored.payments.groupBy("order_id").agg(F.sum("payment_value").alias("v"))
    joined = stored.orders.hint("merge").join(paid, "order_id")
    assert joined.count() == 1
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    spark.sql("DROP DATABASE bucketed_shop CASCADE")


def test_unknown_table_name_is_an_error():
    with pytest.raises(ValueError, match="unknown tables"):
        CommerceTables(customer=None)


def test_feature_table_prefers_parquet_then_csv(spark, tmp_path):
    schema = artifacts.FEATURE_SCHEMA
    values = ["u", 1.5, 2, 1, 1, 1, None, None, 0.0, 0.0, "SP", "sp, city", 10, -1, 0, "boleto", 1.5, 2.0, 3.0, 0.1, 0]
    table = spark.createDataFrame([tuple(values)], schema)
    artifacts.write_features(table, str(tmp_path))
    assert artifacts.read_features(spark, str(tmp_path)).collect() == table.collect()
    only_csv = tmp_path / "csv"
    artifacts.write_report(table, str(only_csv / "customer_features.csv"))
    assert artifacts.read_features(spark, str(only_csv)).collect() == table.collect()
    with pytest.raises(FileNotFoundError):
        artifacts.read_features(spark, str(tmp_path / "none"))


def test_metrics_importance_and_model_files(spark, tmp_path):
    folder = str(tmp_path)
    assert artifacts.read_metrics(spark, folder).count() == 0
    assert artifacts.read_importance(spark, folder).count() == 0
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, folder)
    metrics = spark.createDataFrame(
        [("m", 0.75, 0.7, 0.7, 0.6, 0.6)],
        "model string, roc_auc double, f1 double, precision double, recall double, accuracy double",
    )
    artifacts.write_metrics(metrics, folder)
    assert artifacts.read_metrics(spark, folder).collect() == metrics.collect()
    importance = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "feature string, importance double")
    artifacts.write_importance(importance, folder)
    assert [r["feature"] for r in artifacts.read_importance(spark, folder).collect()] == ["b", "a"]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "sellers.csv").write_text(
        "seller_state,extra,seller_city,seller_id,seller_zip_code_prefix\nSP,1,campinas,s1,13023\nRJ,2,rio,s2,x\n"
    )
    spec = CATALOG["sellers"]
    found = {r["seller_id"]: r for r in read_csv_table(spark, str(tmp_path / "sellers.csv"), spec).collect()}
    assert found["s1"]["seller_city"] == "campinas" and found["s2"]["seller_state"] == "RJ"
    (tmp_path / "short.csv").write_text("seller_id,seller_city\ns1,campinas\n")
    with pytest.raises(ValueError, match="seller_state"):
        read_csv_table(spark, str(tmp_path / "short.csv"), spec)


def test_values_that_do_not_parse_are_counted(spark, tmp_path):
    (tmp_path / "items.csv").write_text(
        ",".join(CATALOG["order_items"].columns) + "\n" + "\n".join(["o1,1,p,s,2018-01-01 00:00:00,9.5,x", "o2,b,p,s,,,1.0"]) + "\n"
    )
    counts = dict(tuple(r) for r in unparsed_values(spark, str(tmp_path / "items.csv"), CATALOG["order_items"]).collect())
    assert {k: v for k, v in counts.items() if v} == {"order_item_id": 1, "freight_value": 1}
