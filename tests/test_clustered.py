from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from bazaarlens.operators.base import order_items_wide
from bazaarlens.operators.filters import Filters, apply_filters
from bazaarlens.plans import batch
from bazaarlens.registry import ORACLE, QUERIES
from bazaarlens.sources import clustered
from bazaarlens.sources.tpch import tables_from_tpch

FOLDER = "/root/testdata/sf0.001"
CHOSEN = Filters(date_range=(date(1996, 3, 10), date(1996, 5, 2)))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_months_prune_files_and_orders_join_in_place(spark, tmp_path):
    items = order_items_wide(tables_from_tpch(spark, FOLDER))
    stored = clustered.store_items(items, "items_by_month", f"{tmp_path}/items", 4)
    assert sorted(map(str, stored.select(items.columns).collect())) == sorted(map(str, items.collect()))

    chosen = apply_filters(stored, CHOSEN)
    assert sorted(map(str, chosen.select(items.columns).collect())) == sorted(map(str, apply_filters(items, CHOSEN).collect()))
    months = chosen.select(F.input_file_name().alias("f")).distinct().collect()
    assert {m.split("month=")[1][:7] for (m,) in months} == {"1996-03", "1996-04", "1996-05"}
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    scan = next(line for line in _plan(chosen).splitlines() if "FileScan" in line)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(month" in scan and "1996-03" in scan

    per_order = stored.groupBy("order_id").agg(F.sum("price").alias("total"))
    joined = chosen.hint("merge").join(per_order, "order_id")
    assert joined.count() == chosen.count()
    assert "Exchange" not in _plan(joined).split("Initial Plan")[0]
    # at most one file for each bucket and month, and a second run replaces the first
    files = len(stored.inputFiles())
    assert files <= 4 * stored.select("month").distinct().count()
    again = clustered.store_items(items, "items_by_month", f"{tmp_path}/items", 4)
    assert again.count() == items.count() and len(again.inputFiles()) == files

    spark.sql("DROP TABLE items_by_month")
    back = clustered.register_items(spark, "items_by_month", f"{tmp_path}/items", 4)
    assert sorted(map(str, back.select(items.columns).collect())) == sorted(map(str, items.collect()))
    assert "Exchange" not in _plan(back.groupBy("order_id").count()).split("Initial Plan")[0]
    spark.sql("DROP TABLE items_by_month")


def test_items_without_a_purchase_time_are_kept_and_not_chosen(spark, tmp_path):
    rows = [("o1", "1996-03", "1996-03-10 00:00:00"), ("o2", "1996-03", "1996-03-09 23:59:59"), ("o3", None, None)]
    items = spark.createDataFrame(rows, "order_id string, month string, t string")
    items = items.select("order_id", "month", F.col("t").cast("timestamp_ntz").alias("order_purchase_timestamp"))
    stored = clustered.store_items(items, "undated_items", f"{tmp_path}/items", 2)
    assert sorted(r["order_id"] for r in stored.collect()) == ["o1", "o2", "o3"]
    assert [r["order_id"] for r in apply_filters(stored, CHOSEN).collect()] == ["o1"]
    empty = clustered.store_items(items.limit(0), "undated_items", f"{tmp_path}/items", 2)
    assert empty.count() == 0
    spark.sql("DROP TABLE undated_items")


def test_registered(spark):
    assert {"b01_clustered_months", "c10_clustered_date_filter"} <= set(QUERIES) & set(ORACLE)
    assert batch.ITEMS_TABLE
