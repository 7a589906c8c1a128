from __future__ import annotations

from decimal import Decimal

import rows

from bazaarlens.functions.columns import display_number
from bazaarlens.operators import base, kpi, product, regional, reports, sales
from pyspark.sql import functions as F


def items(spark, values):
    """(order, month, category, value) rows with the other columns derived from them."""
    return spark.createDataFrame(
        [(o, m, c, Decimal(str(v)), f"person {o}", "S", "santa d'oeste", "p" + str(v), Decimal(str(v)), None, None, 0.0, "boleto", Decimal(0))
         for o, m, c, v in values],
        "order_id string, month string, category string, item_value decimal(19,2), customer_unique_id string, state string, "
        "city string, product_id string, price decimal(18,2), review_score double, delivery_days bigint, is_delayed double, "
        "payment_type string, freight_value decimal(18,2)",
    )


def test_growth_over_the_previous_present_month(spark):
    df = items(spark, [("a", "2020-01", "x", 10), ("b", "2020-03", "x", 15), ("c", None, "x", 99), ("d", "2020-04", "x", 0), ("e", "2020-05", "x", 5)])
    growth = [(r["month"], r["growth_pct"]) for r in sales.monthly_growth(df).collect()]
    assert growth == [("2020-01", None), ("2020-03", 50.0), ("2020-04", -100.0), ("2020-05", None)]


def test_ties_go_to_the_smaller_key(spark):
    df = items(spark, [("a", "m", "z", 5), ("b", "m", "y", 5), ("c", "m", "x", 5), ("d", "m", None, 50)])
    assert [r["category"] for r in product.top_category_revenue(df, 2).collect()] == ["x", "y"]
    assert [r["category"] for r in product.bottom_category_revenue(df, 2).collect()] == ["x", "y"]
    ranked = product.ranked_categories(df, 2).collect()
    assert [(r["rank"], r["category"]) for r in ranked] == [(1, "x"), (2, "y")]


def test_payment_breakdown_counts_first_item_and_whole_order(spark):
    df = items(spark, [("a", "m", "x", 5), ("a", "m", "x", 7), ("b", "m", "x", 1)])
    assert sales.payment_breakdown(df).first().asDict() == {
        "payment_type": "boleto", "orders": 2, "revenue": 6.0, "order_revenue": 13.0,
    }
    unpaid = df.withColumn("payment_type", F.lit(None).cast("string"))
    assert sales.payment_breakdown(unpaid).count() == 0


def test_min_orders_and_missing_reviews(spark):
    df = items(spark, [("a", "m", "x", 5), ("b", "m", "x", 7), ("c", "m", "y", 1)])
    df = df.withColumn("review_score", F.when(F.col("order_id") != "b", 4.0))
    assert [r["category"] for r in product.best_rated_categories(df, 2).collect()] == ["x"]
    none = df.withColumn("review_score", F.lit(None).cast("double"))
    assert product.best_rated_categories(none, 1).count() == 0


def test_trend_ranks_by_the_total_including_undated_rows(spark):
    df = items(spark, [("a", None, "x", 100), ("b", "m", "x", 1), ("c", "m", "y", 50), ("d", "m", "z", 60)])
    assert [tuple(r) for r in sales.category_trend(df, 2).collect()] == [("m", "x", 1.0), ("m", "z", 60.0)]


def test_state_roll_up_equals_distinct_counts(spark):
    df = items(spark, [(f"o{i % 7}", "m", "x", i) for i in range(40)])
    df = df.withColumn("customer_unique_id", F.concat(F.lit("c"), F.substring("order_id", 2, 1).cast("int") % 3))
    plain = df.groupBy("state").agg(F.countDistinct("order_id"), F.countDistinct("customer_unique_id"), F.sum("item_value"))
    mine = regional.state_performance(df).select("state", "orders", "customers", "revenue")
    assert [tuple(map(str, r)) for r in mine.collect()] == [
        (r[0], str(r[1]), str(r[2]), str(float(r[3]))) for r in plain.collect()
    ]


def test_city_label(spark):
    df = items(spark, [("a", "m", "x", 5)])
    assert regional.top_cities(df).first()["label"] == "Santa D'oeste (S)"


def test_reviews_fan_out_without_pairs(spark):
    """Two reviews and three items of one order count six times, but no join makes six rows of them."""
    tables = rows.tables(
        spark,
        customers=[rows.customer("a")],
        products=[{"product_id": "p", "product_category_name": "k"}, {"product_id": "n"}],
        orders=[rows.order("o", "a", "2020-01-01")],
        order_items=[rows.item("o", 1), rows.item("o", 2), rows.item("o", 3), rows.item("o", 4, "n")],
        reviews=[rows.review("o", 5, "1"), rows.review("o", 2, "2")],
    )
    found = rows.by(reports.avg_review_score(tables), "category")
    assert found["k"]["total_reviews"] == 6 and found["k"]["avg_score"] == 3.5
    assert found["k"]["positive_reviews"] == 3 and found["unknown"]["negative_reviews"] == 1


def test_payment_shares_and_unpaid_orders(spark):
    tables = rows.tables(
        spark,
        customers=[rows.customer("a")],
        orders=[rows.order("o", "a", "2020-01-01"), rows.order("u", "a", "2020-01-02")],
        payments=[rows.payment("o", "boleto", 10), rows.payment("o", "boleto", 20, 2), rows.payment("o", "voucher", 3, 3)],
    )
    shares = rows.by(reports.payment_distribution(tables), "payment_type")
    assert shares["boleto"] == {
        "payment_type": "boleto", "total_orders": 1, "total_value": 30.0, "avg_value": 15.0, "pct_of_orders": 50.0,
    }
    assert [tuple(r) for r in reports.monthly_revenue(tables).collect()] == [("2020-01", 1, 33.0)]
    assert [tuple(r) for r in reports.monthly_orders(tables).collect()] == [("2020-01", 2)]


def test_number_text(spark):
    df = spark.createDataFrame([(1234567.0,), (1000.0,), (2250.0,), (999.6,), (12.345,), (None,)], "v double")
    shown = [tuple(r) for r in df.select(display_number(F.col("v"), True), display_number(F.col("v"))).collect()]
    assert shown == [
        ("R$ 1.23M", "1.23M"), ("R$ 1.0k", "1.0k"), ("R$ 2.2k", "2.2k"), ("R$ 999.60", "1,000"), ("R$ 12.34", "12"), (None, None),
    ]


def test_business_context_row(spark):
    df = items(spark, [("a", "m", "x", 5), ("b", "m", "y", 7), ("b", "m", "y", 1)])
    customers = spark.createDataFrame([(1, 1), (0, 2)], "churn int, num_orders bigint")
    context = kpi.business_context(df, customers).first().asDict()
    assert context["total_revenue_BRL"] == 13.0 and context["total_orders"] == 2 and context["avg_order_value_BRL"] == 6.5
    assert context["churn_rate_percent"] == 50.0 and context["repeat_customer_rate_percent"] == 50.0
    assert context["top_5_categories_by_revenue"] == {"y": 8.0, "x": 5.0}
    assert context["payment_method_order_share"] == {"boleto": 2.0}
    assert context["avg_review_score_out_of_5"] is None and '"total_orders":2' in context["context_json"]


def test_best_month_ties_go_to_the_earlier(spark):
    df = items(spark, [("a", "2020-02", "x", 5), ("b", "2020-01", "x", 5), ("c", "2020-03", "x", 1)])
    assert kpi.best_and_worst_month(df).first()[:3] == ("2020-01", 5.0, "2020-03")


def test_means_of_reviews_do_not_depend_on_the_order_of_rows(spark):
    scores = [(o, s) for o in range(300) for s in [(o * 7) % 5 + 1, (o * 3) % 5 + 1, (o * 11) % 4 + 1][: o % 3 + 1]] + [(999, None)]
    found = set()
    for seed in range(6):
        reviews = spark.createDataFrame(scores, "order_id long, review_score int").orderBy(F.rand(seed)).repartition(5)
        per_order = base.review_scores(reviews).orderBy(F.rand(seed)).repartition(4)
        lines = per_order.select(F.lit("c").alias("category"), "order_id", "review_score", F.lit(Decimal(1)).alias("item_value"))
        found.add(product.category_performance(lines).first()["avg_review"])
        assert {r["review_score"] for r in per_order.filter("order_id = 999").collect()} == {None}
    assert len(found) == 1
    thirds = base.review_scores(spark.createDataFrame([(1, 5), (1, 4), (1, 4)], "order_id long, review_score int"))
    assert thirds.first()["review_score"] == Decimal("4.33333333")
