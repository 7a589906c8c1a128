"""Distinct counts from stored sketches."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from bazaarlens.operators import sketches

START = datetime(2020, 1, 1, 9)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """3,000 orders over 30 days, each with two lines; customers return every 500 orders."""
    rows = [(f"o{i}", f"c{i % 500}", "AB"[i % 2], START + timedelta(days=i // 100)) for i in range(3000) for _ in range(2)]
    rows += [("late", None, None, None)]
    items = spark.createDataFrame(rows, "order_id string, customer string, state string, order_purchase_timestamp timestamp")
    path = str(tmp_path_factory.mktemp("sketches") / "days")
    sketches.day_sketches(items, ["order_id", "customer"], ["state"]).write.parquet(path)
    return spark.read.parquet(path)


def near(got: int, exact: int) -> bool:
    return abs(got - exact) <= max(1, 0.065 * exact)


def test_any_range_of_days_is_a_union_of_stored_sketches(stored):
    for first, last, orders, people in ((1, 30, 3000, 500), (3, 3, 100, 100), (5, 12, 800, 500)):
        got = sketches.distinct_counts(stored, ["order_id", "customer"], (), date(2020, 1, first), date(2020, 1, last)).first()
        assert near(got["order_id"], orders) and near(got["customer"], people)


def test_groups_nulls_and_merging_twice(stored):
    values = ["order_id", "customer"]
    got = {r["state"]: (r["order_id"], r["customer"]) for r in sketches.distinct_counts(stored, values, ["state"]).collect()}
    assert got[None] == (1, 0)
    assert near(got["A"][0], 1500) and near(got["B"][1], 250)
    for level in (stored, sketches.merged(stored, values, ["state"])):  # estimates differ a little with the order of unions
        total = sketches.distinct_counts(level, values).first()
        assert near(total["order_id"], 3001) and near(total["customer"], 500)


def test_comparison_sees_what_is_off(spark):
    exact = spark.createDataFrame([("x", 1000), (None, 5), ("y", 3), ("z", 4)], "k string, n long")
    about = spark.createDataFrame([("x", 1100), (None, 6), ("y", 3)], "k string, n long")
    got = {r["k"]: r["n_within"] for r in sketches.compared(exact, about, "k", ["n"]).collect()}
    assert got == {"x": False, None: True, "y": True, "z": False}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "v string, order_purchase_timestamp timestamp")
    assert sketches.day_sketches(empty, ["v"]).collect() == []
