from __future__ import annotations

import math
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
import rows
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from bazaarlens.functions import ordered
from bazaarlens.functions.ordered import exact_medians, order_statistics, running_totals
from bazaarlens.models import evaluate, explain, prep, score, train
from bazaarlens.sources import artifacts

SMALL = train.ModelSettings(forest_trees=8, forest_depth=4, forest_min_leaf=5, boosting_rounds=6, boosting_depth=3)


@pytest.fixture(scope="module")
def features(spark):
    """Customers whose churn depends on two inputs, with gaps in one of them."""
    key = F.col("id")
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    late = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100.0
    days = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(30)).cast("double")
    whole = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5)) + 1
    df = spark.range(0, 800, numPartitions=4).select(
        key.cast("string").alias("customer_unique_id"),
        (noise * 500).alias("total_spend"),
        whole.alias("total_products"),
        F.lit(1).cast("bigint").alias("distinct_categories"),
        whole.alias("distinct_sellers"),
        whole.alias("num_orders"),
        F.when(key % 9 != 0, days).alias("avg_delivery_days"),
        F.when(key % 4 != 0, whole.cast("double")).alias("avg_review_score"),
        late.alias("pct_delayed"),
        noise.alias("weekend_purchase_ratio"),
        F.concat(F.lit("S"), (key % 5).cast("string")).alias("state"),
        F.lit("city").alias("city"),
        key.alias("days_since_first_purchase"),
        key.alias("days_since_last_purchase"),
        (days * 3).cast("bigint").alias("customer_lifetime_days"),
        F.when(key % 3 == 0, "boleto").otherwise("voucher").alias("preferred_payment_method"),
        (noise * 100).alias("avg_order_value"),
        F.lit(1.0).alias("avg_basket_size"),
        F.lit(1.0).alias("purchase_frequency"),
        noise.alias("avg_freight_ratio"),
        F.when(late + days / 30 + noise * 0.4 > 1.0, 1).otherwise(0).alias("churn"),
    )
    return df.cache()


@pytest.fixture(scope="module")
def trained(features):
    return train.train_models(features, SMALL)


@pytest.mark.parametrize("finish", [1, 3, 10_000])
def test_order_statistics_are_exact(spark, monkeypatch, finish):
    monkeypatch.setattr(ordered, "FINISH_SIZE", finish)
    rng = np.random.default_rng(1)
    columns = {
        "smooth": rng.normal(size=501).tolist(),
        "tied": rng.integers(0, 3, size=501).astype(float).tolist(),
        "hot": [7.0] * 400 + list(range(101)),
    }
    data = [tuple(float(columns[c][i]) for c in columns) for i in range(501)] + [(None, None, None)] * 9
    df = spark.createDataFrame(data, "smooth double, tied double, hot double").repartition(5)
    wanted = [0, 125, 250, 499, 500]
    found = order_statistics(df, {c: F.col(c) for c in columns}, lambda _, n: wanted)
    for name, values in columns.items():
        assert found[name] == [sorted(values)[rank] for rank in wanted]


def test_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (10.0, None), (4.0, None)], "a double, b double")
    assert exact_medians(df, ["a", "b"]) == {"a": 3.0, "b": None}


def test_running_totals_across_buckets(spark):
    df = spark.createDataFrame([(i / 100, i) for i in range(100)], "score double, n bigint").repartition(6)
    found = {r["score"]: r["cum_n"] for r in running_totals(df, "score", ["n"], buckets=7).collect()}
    assert found == {i / 100: sum(range(i, 100)) for i in range(100)}
    one = spark.createDataFrame([(0.5, 3)], "score double, n bigint")
    assert running_totals(one, "score", ["n"]).first()["cum_n"] == 3
    assert running_totals(one.limit(0), "score", ["n"]).collect() == []


def test_running_totals_over_a_deep_tree_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGES_PER_NODE", 3)
    df = spark.createDataFrame([((i * 37) % 500 / 4, i % 11, i) for i in range(500)], "score double, m int, n bigint")
    got = running_totals(df, "score", ["m", "n"], buckets=40)
    rows = df.collect()
    for r in got.collect():
        above = [x for x in rows if x["score"] >= r["score"]]
        assert (r["cum_m"], r["cum_n"]) == (sum(x["m"] for x in above), sum(x["n"] for x in above))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Bucketizer" not in plan and "percentile" not in plan
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line and "Window [" in line]
    assert windows and all("windowspecdefinition(node" in line or "windowspecdefinition(_range" in line for line in windows)


def scored(spark, values):
    return spark.createDataFrame(values, "label int, prediction int, score double")


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(3)
    values = [(int(l), int(s > 0.5), float(s)) for l, s in zip(rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 20)]
    df = scored(spark, values).repartition(4)
    positive = [s for l, _, s in values if l]
    negative = [s for l, _, s in values if not l]
    auc = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative) / (len(positive) * len(negative))
    found = evaluate.binary_metrics(df).first()
    assert found["roc_auc"] == pytest.approx(auc, abs=1e-12)
    tp = sum(l and p for l, p, _ in values)
    assert found["precision"] == pytest.approx(tp / sum(p for _, p, _ in values))
    assert found["recall"] == pytest.approx(tp / len(positive))
    for point in evaluate.roc_curve(df).collect():
        assert point["tpr"] == pytest.approx(sum(s >= point["threshold"] for s in positive) / len(positive))
        assert point["fpr"] == pytest.approx(sum(s >= point["threshold"] for s in negative) / len(negative))


def test_no_predicted_positives(spark):
    found = evaluate.threshold_metrics(scored(spark, [(1, 0, 0.1), (0, 0, 0.2)])).first().asDict()
    assert found == {"accuracy": 0.5, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    cells = {(r["label"], r["prediction"]): r["customers"] for r in evaluate.confusion_matrix(scored(spark, [(1, 0, 0.1)])).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_preparation(spark):
    schema = ", ".join(f"{c} double" for c in prep.NUMERIC_INPUTS) + ", state string, preferred_payment_method string"
    data = [(*[float(i)] * 12, None, s, p) for i, s, p in [(1, "b", "x"), (2, "a", None), (4, "a", "y"), (9, "b", "y")]]
    learned = prep.fit_preparation(spark.createDataFrame(data, schema))
    assert learned.medians["total_spend"] == 3.0 and learned.medians["avg_freight_ratio"] is None
    assert learned.modes == {"state": "a", "preferred_payment_method": "y"}
    assert learned.codes == {"state": {"a": 0, "b": 1}, "preferred_payment_method": {"x": 0, "y": 1}}
    new = spark.createDataFrame([(*[None] * 13, "ZZ", None), (*[4.0] * 13, "b'", "x")], schema)
    first, second = prep.apply_preparation(new, learned).collect()
    assert first["total_spend"] == 3.0 and first["state"] == -1.0 and first["preferred_payment_method"] == 1.0
    assert second["state"] == -1.0 and second["preferred_payment_method"] == 0.0
    scaled = prep.apply_preparation(spark.createDataFrame(data, schema), learned, scale=True)
    spread = scaled.agg(F.avg("num_orders"), F.stddev_pop("num_orders")).first()
    assert spread[0] == pytest.approx(0) and spread[1] == pytest.approx(1)
    for scale in (False, True):
        *stages, _ = prep.preparation_stages(learned, scale)
        mine = [tuple(r) for r in PipelineModel(stages).transform(new).select(*[f"_in_{c}" for c in prep.INPUTS]).collect()]
        assert mine == [tuple(r) for r in prep.apply_preparation(new, learned, scale).select(*prep.INPUTS).collect()]


def test_leakage_columns_are_dropped(features):
    inputs = prep.model_inputs(features).columns
    assert set(inputs) == {*prep.INPUTS, "churn"}


def test_split_is_stratified_and_repeatable(features):
    marked = prep.mark_test_rows(features)
    counts = {r["churn"]: (r["n"], r["t"]) for r in marked.groupBy("churn").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    for rows_of_class, test_rows in counts.values():
        assert test_rows == int(0.2 * rows_of_class + 0.5)
    again = prep.mark_test_rows(features.repartition(3))
    assert {r[0] for r in marked.filter("is_test").select(prep.ID).collect()} == {
        r[0] for r in again.filter("is_test").select(prep.ID).collect()
    }


def test_weights(spark):
    found = prep.class_weights(spark.createDataFrame([(0,), (1,), (1,), (1,)], "churn int")).first()
    assert found["weight_0"] == 2.0 and found["weight_1"] == pytest.approx(2 / 3)
    assert found["scale_pos_weight"] == pytest.approx(1 / 3)


def test_models_find_the_signal(trained):
    table = rows.by(trained.comparison(), "model")
    assert set(table) == set(train.FITTERS)
    assert all(row["roc_auc"] > 0.8 for row in table.values())
    assert train.best_of(trained.comparison()) == max(table.values(), key=lambda r: r["roc_auc"])["model"]
    assert trained.roc_curves().select("model").distinct().count() == 3


def test_same_seed_same_scores(features, trained):
    again = train.fit_forest(trained.train, trained.preparation, SMALL)
    one = trained.models[train.FOREST].transform(trained.test).select(prep.ID, "probability")
    two = again.transform(trained.test).select(prep.ID, "probability")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_importance(spark, trained):
    ranked = train.feature_importance(trained.models[train.FOREST], spark).collect()
    assert len(ranked) == 15 and {ranked[0]["feature"], ranked[1]["feature"]} == {"pct_delayed", "avg_delivery_days"} or (
        "customer_lifetime_days" in {ranked[0]["feature"], ranked[1]["feature"]}
    )
    assert sum(r["importance"] for r in ranked) == pytest.approx(1)
    assert train.feature_importance(trained.models[train.LOGISTIC], spark).count() == 0
    assert train.feature_importance(trained.models[train.FOREST], spark, 3).count() == 3


def test_scoring_and_saved_model(spark, features, trained, tmp_path):
    artifacts.save_model(trained.models[train.FOREST], str(tmp_path))
    loaded = artifacts.load_model(spark, str(tmp_path))
    assert artifacts.load_model(spark, str(tmp_path)) is loaded
    mine = score.predict_churn(loaded, features)
    assert sorted(map(str, mine.collect())) == sorted(
        map(str, score.predict_churn(trained.models[train.FOREST], features).collect())
    )
    for row in mine.limit(50).collect():
        assert row["label"] == ("Churned" if row["predicted_class"] else "Active")
        assert row["churn_probability"] == round(row["churn_probability"], 4)


def test_risk_bounds_are_strict(spark):
    df = spark.createDataFrame([(0.61,), (0.6,), (0.35,)], "churn_probability double")
    tiers = [r["risk_tier"] for r in score.add_risk(df).collect()]
    assert tiers == ["High Risk", "Medium Risk", "Low Risk"]


def brute_force_shapley(leaves, x):
    """Shapley values by their definition: the expected output when only a subset of the inputs is known."""
    inputs = sorted({f for path, _ in leaves for f in path})

    def expected(known):
        total = 0.0
        for path, value in leaves:
            for f, (low, high, share) in path.items():
                value *= (low < x[f] <= high) if f in known else share
            total += value
        return total

    out = np.zeros(len(x))
    for f in inputs:
        others = [g for g in inputs if g != f]
        for size in range(len(others) + 1):
            weight = math.factorial(size) * math.factorial(len(others) - size) / math.factorial(len(inputs))
            for known in combinations(others, size):
                out[f] += weight * (expected({*known, f}) - expected(set(known)))
    return out


def test_shapley_values_against_the_definition():
    rng = np.random.default_rng(5)

    def grow(path, depth):
        if depth == 0 or rng.random() < 0.15:
            return [(path, rng.normal())]
        f, cut, share = int(rng.integers(0, 5)), rng.normal(), rng.uniform(0.1, 0.9)
        low, high, before = path.get(f, (-np.inf, np.inf, 1.0))
        left = path | {f: (low, min(high, cut), before * share)}
        right = path | {f: (max(low, cut), high, before * (1 - share))}
        return grow(left, depth - 1) + grow(right, depth - 1)

    leaves = grow({}, 6) + grow({}, 3)
    x = rng.normal(size=(6, 5))
    found = explain.shapley_values(explain.ensemble_from_leaves(leaves), x)
    for row, values in zip(x, found, strict=True):
        assert values == pytest.approx(brute_force_shapley(leaves, row), abs=1e-12)
    # with many rows the values come from tables by pattern
    many = np.repeat(x, 60, axis=0)
    looked_up = explain.shapley_values(explain.ensemble_from_leaves(leaves), many)
    assert looked_up == pytest.approx(np.repeat(found, 60, axis=0), abs=1e-12)


@pytest.mark.parametrize("name", [train.FOREST, train.BOOSTED, train.LOGISTIC])
def test_attributions_add_up_to_the_model_output(trained, name):
    model = trained.models[name]
    parts = explain.attributions(model, trained.test).toPandas()
    total = parts[list(explain.INPUTS)].sum(axis=1) + parts["base_value"]
    output = model.transform(trained.test).select(prep.ID, "rawPrediction", "probability").toPandas()
    merged = output.set_index(prep.ID).loc[parts[prep.ID]]
    column = "probability" if name == train.FOREST else "rawPrediction"
    assert total.to_numpy() == pytest.approx(np.array([v[1] for v in merged[column]]), abs=1e-9)


def test_strongest_attributions(spark):
    df = spark.createDataFrame([("u", 0.1, -0.5, 0.3, 0.0)], f"{prep.ID} string, a double, b double, c double, base_value double")
    top = explain.top_attributions(df, 2, ("a", "b", "c"))
    assert [(r["position"], r["feature"], r["value"]) for r in top.collect()] == [(1, "c", 0.3), (2, "b", -0.5)]
    assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString()
    assert explain.long_form(df, ("a", "b", "c")).count() == 3
    assert explain.global_attributions(df, ("a", "b")).first()["feature"] == "b"


def test_many_categories(spark, features):
    wide = features.select("*").withColumn("state", F.concat(F.lit("S"), F.col("customer_unique_id")))
    more = spark.range(20_000).select(F.concat(F.lit("T"), "id").alias("state"), F.lit("x").alias("preferred_payment_method"))
    learned = prep.fit_preparation(wide.unionByName(more, allowMissingColumns=True))
    assert len(learned.codes["state"]) == 20_800
    assert prep.apply_preparation(wide, learned).agg(F.min("state"), F.max("state")).first() == (0.0, 799.0)


def test_models_do_not_depend_on_how_rows_come(features):
    settings = train.ModelSettings(forest_trees=4, forest_depth=3, forest_min_leaf=5, parts=3)
    trees = set()
    for parts in (1, 7):
        result = train.train_models(features.repartition(parts, "total_spend"), settings, (train.FOREST,))
        assert result.train.rdd.getNumPartitions() == 3
        trees.add(result.models[train.FOREST].stages[-1].toDebugString.split("\n", 1)[1])
    assert len(trees) == 1


def test_one_customer_has_attributions_of_the_whole_table(trained):
    model = trained.models[train.LOGISTIC]
    alone = trained.test.limit(1).cache()
    own = explain.attributions(model, alone).first()
    same = explain.attributions(model, trained.test).filter(F.col(prep.ID) == own[prep.ID]).first()
    assert own == same and any(own[c] for c in prep.INPUTS)


def test_a_model_stored_again_is_the_one_loaded(spark, trained, tmp_path):
    artifacts.save_model(trained.models[train.LOGISTIC], str(tmp_path))
    assert artifacts.load_model(spark, str(tmp_path)) is artifacts.load_model(spark, str(tmp_path))
    artifacts.save_model(trained.models[train.FOREST], str(tmp_path))
    assert artifacts.load_model(spark, str(tmp_path)).stages[-1].uid == trained.models[train.FOREST].stages[-1].uid
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, str(tmp_path / "none"))


def test_more_training_rows_make_more_parts_and_not_larger_ones(features):
    few = train.train_models(features, replace(SMALL, part_rows=1_000), names=()).train
    many = train.train_models(features, replace(SMALL, part_rows=50), names=()).train
    assert few.rdd.getNumPartitions() == SMALL.parts and many.rdd.getNumPartitions() == 13
    assert sorted(r[0] for r in few.select(prep.ID).collect()) == sorted(r[0] for r in many.select(prep.ID).collect())


def test_tables_over_patterns_are_made_once_for_the_rows_of_a_task(spark, monkeypatch):
    """And not again for each batch; the values are those of rows by themselves."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2)).round(1)
    leaves = [({0: (-np.inf, 0.5, 0.6), 1: (-0.5, 0.5, 0.3)}, 1.0), ({0: (0.5, np.inf, 0.4)}, -2.0)]
    ensemble, made, make = explain.ensemble_from_leaves(leaves), spark.sparkContext.accumulator(0), explain._pattern_tables

    def counted(*args):
        made.add(1)
        return make(*args)

    monkeypatch.setattr(explain, "_pattern_tables", counted)
    monkeypatch.setattr(explain, "ROW_BLOCK", 64)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], f"{prep.ID} long, a double, b double").coalesce(1)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = explain.ensemble_attributions(ensemble, df, ("a", "b")).orderBy(prep.ID).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert made.value == 2  # leaves with one input and with two
    alone = [explain.shapley_values(ensemble, row[None])[0] for row in x]
    assert got[["a", "b"]].to_numpy() == pytest.approx(np.array(alone), abs=1e-12)
