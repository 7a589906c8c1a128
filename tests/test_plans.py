from __future__ import annotations

from datetime import date

import pytest

from bazaarlens.functions.storage import materialise, shared_folder
from bazaarlens.models import train
from bazaarlens.operators.base import order_items_wide
from bazaarlens.operators.filters import Filters, apply_filters
from bazaarlens.operators.features import features_from_tables
from bazaarlens.plans import batch, dashboard
from bazaarlens.registry import QUERIES
from bazaarlens.sources import artifacts
from bazaarlens.sources.tables import CommerceTables
from bazaarlens.sources.tpch import tables_from_tpch

FOLDER = "/root/testdata/sf0.001"
SMALL = train.ModelSettings(forest_trees=4, forest_depth=3, forest_min_leaf=2, boosting_rounds=3, boosting_depth=2)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("batch"))
    tables = tables_from_tpch(spark, FOLDER)
    features = batch.build_features(tables, folder)
    return folder, tables, features, batch.train_and_store(features, folder, SMALL)


def test_batch_run(spark, stored):
    folder, tables, features, report = stored
    assert sorted(map(str, features.collect())) == sorted(map(str, features_from_tables(tables).collect()))
    assert report.comparison.count() == 3 and report.best in report.confusion
    metrics = artifacts.read_metrics(spark, folder).first()
    assert metrics["model"] == report.best
    assert report.attributions.count() == 15 and report.classification.count() == 5
    assert artifacts.read_importance(spark, folder).count() == (0 if report.best == train.LOGISTIC else 15)
    for table in batch.validate(tables).values():
        assert table.count() > 0
    assert {name: df.count() for name, df in batch.describe(features).items()}["correlation_matrix"] == 225


def test_dashboard_pages(spark, stored):
    folder, tables, features, report = stored
    items = dashboard.stored_items(tables)
    model = artifacts.load_model(spark, folder)
    chosen = Filters(payment_types=["boleto"])
    pages = [
        dashboard.filter_choices(items),
        dashboard.executive_page(items, features, chosen),
        dashboard.sales_page(items, chosen),
        dashboard.product_page(items, chosen),
        dashboard.regional_page(items, chosen),
        dashboard.customer_page(features),
        dashboard.churn_page(features, model),
        dashboard.insights_page(items, features, chosen),
        dashboard.printed_report(items, features, artifacts.read_metrics(spark, folder), chosen),
    ]
    for page in pages:
        for name, table in page.items():
            rows = table.count()
            assert rows > 0 or name == "best_rated", name
    only = dashboard.sales_page(items, chosen)["payments"].collect()
    assert [r["payment_type"] for r in only] == ["boleto"]
    reasons = dashboard.churn_page(features, model)["reasons_kept"]
    assert reasons.count() == 8 * features.count()


def test_stored_tables_lie_in_the_shared_folder(spark, tmp_path):
    before = shared_folder(spark)
    assert shared_folder(spark) == before
    df = materialise(spark.range(5), "five")
    assert df.count() == 5 and before in df.inputFiles()[0]


@pytest.mark.parametrize(
    "name",
    "s05_orphan_counts b01_order_items_wide c09_clean_items c09_cleaning_audit q05_payment_distribution "
    "q08_avg_review_score q09_top_customers k01_executive_kpis k03_business_context a04_category_trend "
    "a08_payment_breakdown a15_state_performance f21_customer_features e01_dataset_summary".split(),
)
def test_no_plan_has_a_cross_join(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    """On stored tables the status, date and column choices are pushed into the Parquet reader."""
    source = tables_from_tpch(spark, FOLDER)
    for name in ("customers", "orders", "order_items"):
        getattr(source, name).write.parquet(f"{tmp_path}/{name}")
    tables = CommerceTables(
        **{n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("customers", "orders", "order_items")}
    )
    items = order_items_wide(tables, ("order_purchase_timestamp", "item_value"))
    day = date(1996, 3, 1)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = apply_filters(items, Filters(date_range=[day, day]))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    orders = next(line for line in scans if "/orders" in line)
    assert "EqualTo(order_status,delivered)" in orders and "GreaterThanOrEqual(order_purchase_timestamp" in orders
    assert "order_id#" in orders and "order_estimated_delivery_date" not in orders
    assert "seller_id" not in next(line for line in scans if "/order_items" in line)
