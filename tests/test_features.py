from __future__ import annotations

import rows

from bazaarlens.operators import features, profile
from bazaarlens.operators.cleaning import clean_items, clean_orders


def shop(spark):
    orders = [
        # Saturday, Sunday, Monday.
        rows.order("a1", "a1", "2020-01-04T10:00", "2020-01-07T10:00", "2020-01-06"),
        rows.order("a2", "a2", "2020-01-05T10:00"),
        rows.order("a3", "a2", "2020-01-06T09:00", "2020-01-07T10:00", "2020-01-10"),
        rows.order("b1", "b", "2020-07-04T10:00"),
        # 180 and 181 days before 2020-07-04.
        rows.order("c1", "c", "2020-01-05T23:00"),
        rows.order("d1", "d", "2020-01-05T00:00"),
        rows.order("e1", "e", "2020-01-04T00:00"),
    ]
    return rows.tables(
        spark,
        customers=[
            rows.customer("a1", "a", "first", "X"),
            rows.customer("a2", "a", "second", "Y"),
            *[rows.customer(k) for k in "bcde"],
        ],
        products=[{"product_id": "p", "product_category_name": "k1"}, {"product_id": "q", "product_category_name": "k2"}],
        orders=orders,
        order_items=[
            rows.item("a1", 1, "p", "v", 10, 2),
            rows.item("a1", 2, "q", "w", 20, 3),
            rows.item("a2", 1, "p", "v", 30, 0),
            rows.item("a3", 1, "p", "v", 5, 5),
            *[rows.item(o["order_id"]) for o in orders[3:]],
        ],
        payments=[rows.payment("a1", "voucher"), rows.payment("a2", "boleto"), rows.payment("b1", "voucher")],
        reviews=[rows.review("a1", 5, "1"), rows.review("a1", 2, "2"), rows.review("a2", 1, "3")],
    )


def test_customer_features(spark):
    tables = shop(spark)
    built = features.features_from_tables(tables)
    assert tuple(built.columns) == features.FEATURE_COLUMNS
    table = rows.by(built, "customer_unique_id")
    a = table["a"]
    assert a["total_spend"] == 75.0 and a["total_products"] == 4 and a["num_orders"] == 3
    assert a["distinct_categories"] == 2 and a["distinct_sellers"] == 2
    assert a["avg_delivery_days"] == 2.0  # 3 and 1; the undelivered order is skipped
    assert a["avg_review_score"] == 2.25 and a["pct_delayed"] == 0.3333
    assert a["weekend_purchase_ratio"] == 0.6667
    assert (a["city"], a["state"]) == ("first", "X")
    # boleto, voucher and unknown once each: the alphabetically first wins.
    assert a["preferred_payment_method"] == "boleto"
    assert a["avg_order_value"] == 25.0 and a["avg_basket_size"] == 1.3333
    assert a["avg_freight_ratio"] == round(10 / 75, 4)
    assert a["customer_lifetime_days"] == 1
    # The last purchase of all is later on the reference day than its midnight.
    b = table["b"]
    assert b["days_since_last_purchase"] == -1 and b["purchase_frequency"] == 30.0
    assert b["avg_review_score"] is None and b["churn"] == 0
    assert table["c"]["days_since_last_purchase"] == 180 and table["c"]["churn"] == 0
    assert table["d"]["days_since_last_purchase"] == 181 and table["d"]["churn"] == 1
    assert table["c"]["preferred_payment_method"] == "unknown"

    of_items = features.customer_features(clean_items(tables))
    assert sorted(map(str, of_items.collect())) == sorted(map(str, built.collect()))


def test_churn_days_is_a_parameter(spark):
    table = rows.by(features.features_from_tables(shop(spark), churn_days=179), "customer_unique_id")
    assert table["c"]["churn"] == 1


def test_order_level_does_not_depend_on_partitioning(spark):
    orders = clean_orders(shop(spark))
    one, many = features.order_level(orders.coalesce(1)), features.order_level(orders.repartition(7))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def feature_rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_review_distribution_rounds_half_to_even(spark):
    df = feature_rows(spark, [(2.5,), (3.5,), (None,), (4.5,)], "avg_review_score double")
    assert [tuple(r) for r in profile.review_distribution(df).collect()] == [(2, 1), (4, 2)]


def test_histogram(spark):
    df = feature_rows(spark, [(0.0,), (1.0,), (9.99,), (10.0,), (None,)], "total_spend double")
    assert [(r["bin"], r["customers"], r["bin_end"]) for r in profile.spend_histogram(df, 10).collect()] == [
        (0, 1, 1.0),
        (1, 1, 2.0),
        (9, 2, 10.0),
    ]
    flat = feature_rows(spark, [(3.0,), (3.0,)], "total_spend double")
    assert [(r["bin"], r["customers"]) for r in profile.spend_histogram(flat, 10).collect()] == [(0, 2)]


def test_correlation_is_pairwise_complete(spark):
    df = feature_rows(
        spark, [(1.0, 2.0, None), (2.0, 4.0, 5.0), (3.0, 6.0, 4.0), (4.0, 9.0, None)], "a double, b double, c double"
    )
    found = profile.correlation_matrix(df, "abc")
    cells = {(r["column_a"], r["column_b"]): r["r"] for r in found.collect()}
    assert cells["a", "a"] == 1.0 and cells["a", "c"] == -1.0 and cells["c", "a"] == -1.0 and len(cells) == 9
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_profile_text_keeps_nulls(spark):
    table = features.features_from_tables(shop(spark))
    text = profile.customer_profile(table, "b").first().asDict()
    assert text["avg_review_score"] is None and text["total_spend"] == "11.00" and text["num_orders"] == "1"
    assert profile.customer_profile(table, "nobody").count() == 0


def test_sample_is_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "customer_unique_id")
    one = {r[0] for r in profile.customer_sample(df, 50).collect()}
    two = {r[0] for r in profile.customer_sample(df.repartition(5), 50).collect()}
    other = {r[0] for r in profile.customer_sample(df, 50, seed=7).collect()}
    assert one == two and len(one) == 50 and one != other
