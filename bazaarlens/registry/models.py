from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import half_even
from bazaarlens.functions.storage import materialise, scratch_path
from bazaarlens.models import boosting, encoding, evaluate, explain, prep, score, train
from bazaarlens.registry.core import ORACLE, Source, register, settled
from bazaarlens.registry.views import he, mean

_SCALED_INPUTS = ("total_spend", "num_orders", "avg_delivery_days", "pct_delayed", "avg_basket_size")
# Fixed coefficients, so that both engines can compute the attributions of the same linear model.
_COEFFICIENTS = {"num_orders": -0.5, "pct_delayed": 1.75, "avg_basket_size": 0.125}
_INTERCEPT = 0.25


def _prepared(s: Source, scale: bool = False) -> DataFrame:
    features = s.stored_features
    return prep.apply_preparation(features, prep.fit_preparation(features), scale)


def _medians(s: Source) -> DataFrame:
    found = prep.medians(s.stored_features)
    return s.spark.createDataFrame(list(found.items()), "feature string, median double")


def _modes(s: Source) -> DataFrame:
    return s.spark.createDataFrame(list(prep.modes(s.features).items()), "feature string, mode string")


register(
    "m01_model_inputs",
    lambda s: prep.model_inputs(s.features),
    f"SELECT {', '.join(prep.INPUTS)}, churn FROM v_features",
)
register(
    "m02_medians",
    lambda s: settled(_medians(s)),
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {he(f'median({c})')} AS median FROM v_features" for c in prep.NUMERIC_INPUTS
    ),
)
register(
    "m02_imputed_numbers",
    lambda s: settled(_prepared(s).select(prep.ID, "avg_review_score", "avg_delivery_days")),
    f"""SELECT customer_unique_id,
               {he('COALESCE(avg_review_score, (SELECT median(avg_review_score) FROM v_features))')} AS avg_review_score,
               {he('COALESCE(avg_delivery_days, (SELECT median(avg_delivery_days) FROM v_features))')}
                   AS avg_delivery_days
        FROM v_features""",
)
register(
    "m03_modes",
    _modes,
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (SELECT {c} FROM v_features WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS mode"
        for c in prep.CATEGORICAL_INPUTS
    ),
)
register(
    "m04_category_codes",
    lambda s: _prepared(s).select(prep.ID, *prep.CATEGORICAL_INPUTS),
    "SELECT customer_unique_id, "
    + ", ".join(f"CAST(DENSE_RANK() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}" for c in prep.CATEGORICAL_INPUTS)
    + " FROM v_features",
)


def _joined_codes(s: Source) -> DataFrame:
    """The same codes by a stored table and joins."""
    folder = scratch_path(s.spark, "codes")
    fills = prep.modes(s.stored_features)
    encoding.write_codes(encoding.category_tables(s.stored_features, fills), folder)
    wanted = s.stored_features.select(prep.ID, *prep.CATEGORICAL_INPUTS)
    return encoding.encode(wanted, encoding.read_codes(s.spark, folder), fills)


register("m04_codes_by_join", _joined_codes)
ORACLE["m04_codes_by_join"] = ORACLE["m04_category_codes"]
register(
    "m05_scaled_inputs",
    lambda s: settled(_prepared(s, scale=True).select(prep.ID, *_SCALED_INPUTS)),
    f"""WITH filled AS (SELECT customer_unique_id, total_spend, num_orders, pct_delayed, avg_basket_size,
                   COALESCE(avg_delivery_days, (SELECT median(avg_delivery_days) FROM v_features)) AS avg_delivery_days
                   FROM v_features),
             m AS (SELECT {', '.join(f'AVG({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _SCALED_INPUTS)} FROM filled)
        SELECT customer_unique_id, {', '.join(f'{he(f"({c} - m_{c}) / s_{c}")} AS {c}' for c in _SCALED_INPUTS)}
        FROM filled, m""",
)
register(
    "m06_stratified_split",
    lambda s: prep.mark_test_rows(s.stored_features).select(prep.ID, prep.LABEL, "is_test"),
    """SELECT customer_unique_id, churn,
              ROW_NUMBER() OVER (PARTITION BY churn ORDER BY substr(md5(concat_ws(':', 42, customer_unique_id)), 1, 13))
              <= floor(0.2 * COUNT(*) OVER (PARTITION BY churn) + 0.5) AS is_test
       FROM v_features""",
)
register(
    "m07_class_weights",
    lambda s: settled(prep.class_weights(s.features)),
    f"""SELECT n AS negatives, p AS positives, {he('(n + p) / (2.0::DOUBLE * n)')} AS weight_0,
               {he('(n + p) / (2.0::DOUBLE * p)')} AS weight_1, {he(mean('n', 'p'))} AS scale_pos_weight
        FROM (SELECT COUNT(*) FILTER (WHERE churn = 0) AS n, COUNT(*) FILTER (WHERE churn = 1) AS p FROM v_features)""",
)


def _closed_form(s: Source) -> DataFrame:
    """A score without a fitted model: both engines compute it to the last bit. Stored, like a model's scores."""
    slow = F.coalesce(F.col("avg_delivery_days"), F.lit(0.0))
    value = half_even(slow / (slow + 14.0), 2)
    scored = s.features.select(
        prep.ID,
        F.col("churn").alias("label"),
        value.alias("score"),
        (value > 0.5).cast("int").alias("prediction"),
    )
    return materialise(scored, "scored")


_HALF_POINTS = {"slow": 28.0, "middle": 14.0, "fast": 7.0}


def scores(s: Source) -> dict[str, DataFrame]:
    """The same kind of score with three half points, as if of three models."""
    days = F.coalesce(F.col("avg_delivery_days"), F.lit(0.0))
    features, out = s.stored_features, {}
    for name, half in _HALF_POINTS.items():
        value = half_even(days / (days + half), 2)
        columns = [value.alias("score"), (value > 0.5).cast("int").alias("prediction")]
        out[name] = features.select(prep.ID, F.col("churn").alias("label"), *columns)
    return out


def _scores_sql(half: float) -> str:
    days = "COALESCE(avg_delivery_days, 0.0)"
    return (
        "(SELECT label, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction FROM "
        f"(SELECT churn AS label, {he(f'{days} / ({days} + {half})', 2)} AS score FROM v_features))"
    )


_RATIO = "COALESCE(CAST({} AS DOUBLE) / NULLIF(CAST({} AS DOUBLE), 0), 0)"
_CELLS = """(SELECT COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                    COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                    COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
                    COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM v_scored)"""
_ACCURACY = _RATIO.format("tp + tn", "tp + tn + fp + fn")
_CHURNED = [_RATIO.format("tp", "tp + fp"), _RATIO.format("tp", "tp + fn"), _RATIO.format("2 * tp", "2 * tp + fp + fn")]
_ACTIVE = [_RATIO.format("tn", "tn + fn"), _RATIO.format("tn", "tn + fp"), _RATIO.format("2 * tn", "2 * tn + fp + fn")]
_AUC = """(SELECT (SUM(CASE WHEN label = 1 THEN r ELSE 0 END) - SUM(label) * (SUM(label) + 1) / 2.0::DOUBLE)
                  / (SUM(label) * CAST(COUNT(*) - SUM(label) AS DOUBLE))
           FROM (SELECT label, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r
                 FROM v_scored))"""

register(
    "m11_binary_metrics",
    lambda s: settled(evaluate.binary_metrics(_closed_form(s))),
    f"""SELECT {he(_ACCURACY)} AS accuracy, {he(_CHURNED[0])} AS precision, {he(_CHURNED[1])} AS recall,
               {he(_CHURNED[2])} AS f1, {he(_AUC)} AS roc_auc FROM {_CELLS}""",
)
register(
    "m12_roc_curve",
    lambda s: settled(evaluate.roc_curve(_closed_form(s))),
    f"""SELECT score AS threshold,
               {he('SUM(n) OVER (ORDER BY score DESC) / CAST(SUM(n) OVER () AS DOUBLE)')} AS fpr,
               {he('SUM(p) OVER (ORDER BY score DESC) / CAST(SUM(p) OVER () AS DOUBLE)')} AS tpr
        FROM (SELECT score, SUM(label) AS p, SUM(1 - label) AS n FROM v_scored GROUP BY score)""",
)
register(
    "m14_score_comparison",
    lambda s: evaluate.compare_models(scores(s)),
    " UNION ALL ".join(
        f"SELECT '{name}' AS model, {he(_ACCURACY)} AS accuracy, {he(_CHURNED[0])} AS precision, {he(_CHURNED[1])} AS recall, "
        f"{he(_CHURNED[2])} AS f1, {he(_AUC)} AS roc_auc FROM {_CELLS}".replace("v_scored", _scores_sql(half))
        for name, half in _HALF_POINTS.items()
    ),
)
register(
    "m13_confusion_matrix",
    lambda s: evaluate.confusion_matrix(_closed_form(s)),
    """SELECT a.x AS label, b.x AS prediction,
              (SELECT COUNT(*) FROM v_scored v WHERE v.label = a.x AND v.prediction = b.x) AS customers
       FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(x)""",
)


def _report_line(name: str, values, support: str) -> str:
    p, r, f = (he(v) for v in values)
    return f"SELECT '{name}' AS class, {p} AS precision, {r} AS recall, {f} AS f1, {support} AS support FROM {_CELLS}"


_N_ACTIVE, _N_CHURNED, _N = "(tn + fp)", "(tp + fn)", "(tn + fp + tp + fn)"
register(
    "m16_classification_report",
    lambda s: settled(evaluate.classification_report(_closed_form(s))),
    " UNION ALL ".join(
        [
            _report_line("Active", _ACTIVE, _N_ACTIVE),
            _report_line("Churned", _CHURNED, _N_CHURNED),
            _report_line("accuracy", [_ACCURACY] * 3, _N),
            _report_line("macro avg", [f"({a} + {c}) / 2" for a, c in zip(_ACTIVE, _CHURNED)], _N),
            _report_line(
                "weighted avg",
                [f"({a} * {_N_ACTIVE} + {c} * {_N_CHURNED}) / CAST({_N} AS DOUBLE)" for a, c in zip(_ACTIVE, _CHURNED)],
                _N,
            ),
        ]
    ),
)
register(
    "m18_risk_tiers",
    lambda s: score.add_risk(_closed_form(s), "score").select(prep.ID, "score", "risk_tier", "action"),
    "SELECT customer_unique_id, score, "
    "CASE WHEN score > 0.6 THEN 'High Risk' WHEN score > 0.35 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_tier, "
    f"CASE WHEN score > 0.6 THEN '{score.ACTIONS['High Risk']}' WHEN score > 0.35 THEN '{score.ACTIONS['Medium Risk']}' "
    f"ELSE '{score.ACTIONS['Low Risk']}' END AS action FROM v_scored",
)


def _linear(s: Source) -> DataFrame:
    return explain.linear_attributions(s.stored_features, _COEFFICIENTS, _INTERCEPT, background=s.stored_features)


register(
    "m19_linear_attributions",
    lambda s: settled(_linear(s)),
    f"SELECT customer_unique_id, {', '.join(f'{he(c)} AS {c}' for c in ('base_value', *_COEFFICIENTS))} FROM v_linear",
)
register(
    "m21_strongest_attributions",
    lambda s: explain.top_attributions(_linear(s), 2, tuple(_COEFFICIENTS)),
    f"""SELECT customer_unique_id, CAST(ROW_NUMBER() OVER (PARTITION BY customer_unique_id ORDER BY value DESC, feature)
               AS INT) AS position, feature, {he('value')} AS value
        FROM (SELECT customer_unique_id, feature, value
              FROM (UNPIVOT v_linear ON num_orders, pct_delayed, avg_basket_size INTO NAME feature VALUE value)
              QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_unique_id ORDER BY abs(value) DESC, feature) <= 2)""",
)
register(
    "m22_global_linear_attributions",
    lambda s: settled(explain.global_attributions(explain.attribution_sample(_linear(s)), tuple(_COEFFICIENTS))),
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {he(f'AVG(abs({c}))')} AS mean_abs_value FROM (SELECT * FROM v_linear "
        f"ORDER BY md5(concat_ws(':', 42, customer_unique_id)), customer_unique_id LIMIT 500)"
        for c in _COEFFICIENTS
    ),
)

# One tree that both engines can compute: orders up to 1 give 0.2, others -0.1 or 0.4 by the share of delayed orders.
_TREE = [
    ({0: (float("-inf"), 1.0, 0.6)}, 0.2),
    ({0: (1.0, float("inf"), 0.4), 1: (float("-inf"), 0.5, 0.7)}, -0.1),
    ({0: (1.0, float("inf"), 0.4), 1: (0.5, float("inf"), 0.3)}, 0.4),
]
register(
    "m20_small_tree_attributions",
    lambda s: settled(
        explain.ensemble_attributions(
            explain.ensemble_from_leaves(_TREE),
            s.features.select(prep.ID, F.col("num_orders").cast("double"), "pct_delayed").fillna(0.0),
            ("num_orders", "pct_delayed"),
        )
    ),
    f"""WITH k AS (SELECT customer_unique_id, num_orders <= 1 AS few, CASE WHEN COALESCE(pct_delayed, 0.0) <= 0.5 THEN -0.1 ELSE 0.4 END AS leaf
                   FROM v_features),
             v AS (SELECT customer_unique_id, 0.14::DOUBLE AS none, CASE WHEN few THEN 0.2 ELSE 0.05 END::DOUBLE AS orders,
                   (0.12 + 0.4 * leaf)::DOUBLE AS late, CASE WHEN few THEN 0.2 ELSE leaf END::DOUBLE AS joint FROM k)
        SELECT customer_unique_id, {he('none')} AS base_value, {he('((orders - none) + (joint - late)) / 2')} AS num_orders,
               {he('((late - none) + (joint - orders)) / 2')} AS pct_delayed FROM v""",
)

# Fitted models have no SQL counterpart. A model is fitted once per application and data folder, like a saved one.
_fitted: dict[tuple[str, str], train.TrainingResult] = {}


def trained(s: Source, *names: str) -> train.TrainingResult:
    application = s.spark.sparkContext.applicationId
    known = _fitted.get((application, s.folder))
    missing = [n for n in names if known is None or n not in known.models]
    if missing or known is None:
        new = (
            train.train_models(s.stored_features, names=tuple(missing))
            if known is None
            else train.add_models(known, tuple(missing))
        )
        _fitted[(application, s.folder)] = known = new
    return known


def _scored(s: Source, name: str) -> DataFrame:
    return trained(s, name).scored[name]


register("m08_logistic_regression", lambda s: _scored(s, train.LOGISTIC))
register("m09_random_forest", lambda s: _scored(s, train.FOREST))
register("m10_boosted_trees", lambda s: _scored(s, train.BOOSTED))
register("m12_roc_curves_of_models", lambda s: trained(s, *train.FITTERS).roc_curves())
register("m14_model_comparison", lambda s: trained(s, *train.FITTERS).comparison())
register(
    "m15_forest_importance",
    lambda s: train.feature_importance(trained(s, train.FOREST).models[train.FOREST], s.spark),
)
register(
    "m15_boosted_importance",
    lambda s: train.feature_importance(trained(s, train.BOOSTED).models[train.BOOSTED], s.spark, 15),
)
register(
    "m17_scored_customers",
    lambda s: score.add_risk(score.predict_churn(trained(s, train.FOREST).models[train.FOREST], s.stored_features)),
)


def _tree_attributions(s: Source, name: str) -> DataFrame:
    return explain.tree_attributions(trained(s, name).models[name], s.stored_features)


register("m20_forest_attributions", lambda s: _tree_attributions(s, train.FOREST))
register("m20_boosted_attributions", lambda s: _tree_attributions(s, train.BOOSTED))
register("m21_top_tree_attributions", lambda s: explain.top_attributions(_tree_attributions(s, train.FOREST), 12))
register(
    "m22_global_tree_attributions",
    lambda s: explain.global_attributions(
        explain.tree_attributions(
            trained(s, train.FOREST).models[train.FOREST],
            explain.attribution_sample(trained(s, train.FOREST).test),
        )
    ),
)


# What must hold for every row of a fitted model, whatever its numbers are.
register(
    "m08_gradient_is_zero",
    lambda s: train.logistic_gradient(trained(s, train.LOGISTIC).models[train.LOGISTIC], trained(s, train.LOGISTIC).train).select(
        "feature", (F.abs("gradient") < 1e-3).alias("is_zero")
    ),
    " UNION ALL ".join(f"SELECT '{c}' AS feature, TRUE AS is_zero" for c in prep.INPUTS),
)


def _forest_importance(s: Source) -> DataFrame:
    found = train.feature_importance(trained(s, train.FOREST).models[train.FOREST], s.spark)
    return found.agg(
        F.count("*").alias("features"),
        (F.min("importance") >= 0).alias("none_negative"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_is_one"),
    )


register(
    "m15_importance_is_a_share",
    _forest_importance,
    f"SELECT CAST({len(prep.INPUTS)} AS BIGINT) AS features, TRUE AS none_negative, TRUE AS sum_is_one",
)
register(
    "m17_classes_follow_probabilities",
    lambda s: score.predict_churn(trained(s, train.FOREST).models[train.FOREST], s.stored_features).select(
        prep.ID,
        (
            F.col("churn_probability").between(0, 1)
            & ((F.col("predicted_class") == 1) == (F.col("label") == "Churned"))
            # at exactly one half, rounded, either class may stand
            & (((F.col("churn_probability") > 0.5) == (F.col("predicted_class") == 1)) | (F.col("churn_probability") == 0.5))
        ).alias("agrees"),
    ),
    "SELECT customer_unique_id, TRUE AS agrees FROM v_features",
)


def _adds_up(s: Source) -> DataFrame:
    model = trained(s, train.FOREST).models[train.FOREST]
    parts = explain.tree_attributions(model, s.stored_features)
    total = parts.select(prep.ID, sum((F.col(c) for c in prep.INPUTS), F.col("base_value")).alias("total"))
    output = model.transform(s.stored_features).select(prep.ID, vector_to_array("probability")[1].alias("p"))
    return total.join(output, prep.ID).select(prep.ID, (F.abs(F.col("total") - F.col("p")) < 1e-9).alias("adds_up"))


register("m20_forest_attributions_add_up", _adds_up, "SELECT customer_unique_id, TRUE AS adds_up FROM v_features")


_boosted: dict[tuple[str, str], boosting.BoostedModel] = {}


def second_order(s: Source) -> tuple[boosting.BoostedModel, train.TrainingResult]:
    """The second-order model of the same training rows, fitted once like the others."""
    result = trained(s)
    key = (s.spark.sparkContext.applicationId, s.folder)
    if key not in _boosted:
        _boosted[key] = train.fit_second_order(result.train, result.preparation)
    return _boosted[key], result


def _second_order_scores(s: Source) -> DataFrame:
    model, result = second_order(s)
    return train.score_second_order(model, result.preparation, result.test)


register("m10_second_order_trees", _second_order_scores)
register(
    "m14_boosters_compared",
    lambda s: evaluate.compare_models(
        {train.BOOSTED: _scored(s, train.BOOSTED), train.SECOND_ORDER: materialise(_second_order_scores(s), "scored")}
    ),
)


def _second_order_adds_up(s: Source) -> DataFrame:
    model, result = second_order(s)
    inputs = prep.apply_preparation(s.stored_features, result.preparation)
    parts = explain.ensemble_attributions(model.ensemble(), explain.in_tasks(inputs, s.stored_features.count()))
    total = parts.select(prep.ID, sum((F.col(c) for c in prep.INPUTS), F.col("base_value")).alias("total"))
    output = model.score(inputs)
    return total.join(output, prep.ID).select(prep.ID, (F.abs(F.col("total") - F.col("margin")) < 1e-9).alias("adds_up"))


register("m20_second_order_attributions_add_up", _second_order_adds_up, "SELECT customer_unique_id, TRUE AS adds_up FROM v_features")

# A first tree that both engines can grow: given cut points, all rows and inputs, two levels.
_CUTS = {
    "num_orders": (1.0, 2.0, 3.0, 5.0, 8.0, 13.0),
    "total_spend": (20_000.0, 50_000.0, 100_000.0, 200_000.0, 400_000.0, 800_000.0),
    "pct_delayed": (0.1, 0.3, 0.5, 0.7, 0.9),
    "avg_basket_size": (1.5, 2.5, 3.5, 4.5, 5.5),
}
_FIRST_TREE = boosting.BoostingSettings(rounds=1, depth=2, learning_rate=0.1, row_share=1.0, column_share=1.0, max_bins=16)


def _first_tree(s: Source) -> DataFrame:
    rows = s.stored_features.select(prep.ID, prep.LABEL, *[F.col(c).cast("double").alias(c) for c in _CUTS])
    weight = prep.class_weights(rows).first()["scale_pos_weight"]
    model = boosting.fit(rows, weight, _FIRST_TREE, inputs=tuple(_CUTS), cuts=_CUTS)
    return settled(model.nodes(s.spark).select("node", "feature", "cut", "cover", "value"))


def _tree_level(rows: str) -> str:
    """The best split of each node of ``rows`` (id, node, g, h), from its sums on both sides of each cut point."""
    strength = "pow({0} / {2}, 2) / ({1} / {2} + 1.0)"
    left, right, whole = (strength.format(g, h, f"{boosting.GRAIN}.0") for g, h in (("lg", "lh"), ("(tg - lg)", "(th - lh)"), ("tg", "th")))
    return f"""(SELECT node, input, feature, cut, tg, th, lg, lh FROM
        (SELECT *, round(({left} + {right} - {whole}) / 2, 9) AS gain FROM
          (SELECT r.node, c.input, c.feature, c.cut, SUM(g) AS tg, SUM(h) AS th,
                  SUM(CASE WHEN x.value <= c.cut THEN g ELSE 0 END) AS lg, SUM(CASE WHEN x.value <= c.cut THEN h ELSE 0 END) AS lh
           FROM {rows} r JOIN x USING (customer_unique_id) JOIN c USING (feature) GROUP BY ALL))
        WHERE lh >= {boosting.GRAIN} AND th - lh >= {boosting.GRAIN} AND gain > 1e-9
        QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, input, cut) = 1)"""


_cut_rows = ", ".join(f"({i}, '{name}', CAST({cut} AS DOUBLE))" for i, (name, cuts) in enumerate(_CUTS.items()) for cut in cuts)
_weighted = "CAST(floor({} * CASE WHEN churn = 1 THEN w ELSE 1.0::DOUBLE END * " + f"{boosting.GRAIN}.0 + 0.5) AS BIGINT)"
_node_value = he(f"-0.1::DOUBLE * (g / {boosting.GRAIN}.0::DOUBLE) / (h / {boosting.GRAIN}.0::DOUBLE + 1.0)")
register(
    "m10_second_order_first_tree",
    _first_tree,
    f"""WITH c(input, feature, cut) AS (VALUES {_cut_rows}),
    x AS (SELECT customer_unique_id, feature, value FROM
          (UNPIVOT (SELECT customer_unique_id, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in _CUTS)} FROM v_features)
           ON {', '.join(_CUTS)} INTO NAME feature VALUE value)),
    r0 AS (SELECT customer_unique_id, 0 AS node, {_weighted.format('(0.5::DOUBLE - churn)')} AS g, {_weighted.format('0.25::DOUBLE')} AS h
           FROM v_features, (SELECT {mean('COUNT(*) FILTER (WHERE churn = 0)', 'COUNT(*) FILTER (WHERE churn = 1)')} AS w FROM v_features)),
    b0 AS {_tree_level('r0')},
    r1 AS (SELECT customer_unique_id, 2 * r.node + CASE WHEN x.value <= b.cut THEN 1 ELSE 2 END AS node, g, h
           FROM r0 r JOIN b0 b USING (node) JOIN x USING (customer_unique_id) WHERE x.feature = b.feature),
    b1 AS {_tree_level('r1')},
    r2 AS (SELECT customer_unique_id, 2 * r.node + CASE WHEN x.value <= b.cut THEN 1 ELSE 2 END AS node, g, h
           FROM r1 r JOIN b1 b USING (node) JOIN x USING (customer_unique_id) WHERE x.feature = b.feature),
    n AS (SELECT node, SUM(g) AS g, SUM(h) AS h FROM (FROM r0 UNION ALL FROM r1 UNION ALL FROM r2) GROUP BY node)
    SELECT CAST(n.node AS INTEGER) AS node, feature, {he('COALESCE(cut, 0)')} AS cut, {he(f'h / {boosting.GRAIN}.0::DOUBLE')} AS cover, {_node_value} AS value
    FROM n LEFT JOIN (SELECT node, feature, cut FROM b0 UNION ALL SELECT node, feature, cut FROM b1) USING (node)""",
)
