from __future__ import annotations

import pytest

from bazaarlens.models import encoding, prep

SCHEMA = "customer_unique_id string, state string, preferred_payment_method string"


@pytest.mark.parametrize("buckets", [1, 7])
def test_codes_equal_the_sorted_order(spark, buckets):
    rows = [(f"u{i}", None if i % 5 == 0 else f"s{i * 37 % 900}", "x") for i in range(3000)]
    train = spark.createDataFrame(rows, SCHEMA)
    found = encoding.category_table(train, "state", "zz", buckets).collect()
    assert {r["value"]: r["code"] for r in found} == prep.category_codes(train, "state", "zz")


def test_encoding_by_join_with_missing_unseen_and_hot_values(spark, tmp_path):
    train = spark.createDataFrame([("u1", "b", None), ("u2", "a", None), ("u3", "b", None)], SCHEMA)
    fills = {"state": "b", "preferred_payment_method": None}
    encoding.write_codes(encoding.category_tables(train, fills), str(tmp_path))
    codes = encoding.read_codes(spark, str(tmp_path))
    assert sorted(map(tuple, codes.collect())) == [("state", "a", 0), ("state", "b", 1)]
    rows = [("u1", "a", "x"), ("u2", None, None), ("u3", "new", "y"), ("u3", "a", "x"), (None, "", None)]
    new = spark.createDataFrame(rows, SCHEMA)
    out = encoding.encode(new, codes, fills)
    assert out.columns == new.columns
    got = sorted((r[0] or "", r[1], r[2]) for r in out.collect())
    assert got == [("", -1.0, -1.0), ("u1", 0.0, -1.0), ("u2", 1.0, -1.0), ("u3", -1.0, -1.0), ("u3", 0.0, -1.0)]
    assert encoding.encode(new.limit(0), codes, fills).count() == 0
    hot = spark.createDataFrame([(f"u{i}", "b" if i % 3 else "a", None) for i in range(999)], SCHEMA)
    assert {tuple(r) for r in encoding.encode(hot, codes, fills).groupBy("state").count().collect()} == {(0.0, 333), (1.0, 666)}
