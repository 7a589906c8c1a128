"""Batch scoring with a fitted pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import half_even
from bazaarlens.models.prep import ID, LABEL, model_inputs
from bazaarlens.operators.profile import churn_label

# Risk tiers by lower bound (exclusive). Each tier has a code for what to do with its customers.
HIGH_RISK = 0.6
MEDIUM_RISK = 0.35
ACTIONS = {"High Risk": "win_back", "Medium Risk": "remind", "Low Risk": "leave"}


def scored_labels(model: PipelineModel, features: DataFrame) -> DataFrame:
    """``id, label, prediction, score`` for evaluation."""
    return model.transform(features).select(
        ID,
        F.col(LABEL).cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
    )


def predict_churn(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Class, probability of churn (4 decimals) and label for every customer of the table."""
    inputs = model_inputs(features, keep=(ID,)).drop(LABEL)
    return model.transform(inputs).select(
        ID,
        F.col("prediction").cast("int").alias("predicted_class"),
        half_even(vector_to_array("probability")[1], 4).alias("churn_probability"),
        churn_label("prediction").alias("label"),
    )


def risk_tier(probability: Column) -> Column:
    return (
        F.when(probability > HIGH_RISK, "High Risk")
        .when(probability > MEDIUM_RISK, "Medium Risk")
        .otherwise("Low Risk")
    )


def add_risk(scored: DataFrame, probability: str = "churn_probability") -> DataFrame:
    """Add ``risk_tier`` and the ``action`` for it."""
    tier = F.col("risk_tier")
    action = F.lit(None)
    for name, text in ACTIONS.items():
        action = F.when(tier == name, text).otherwise(action)
    return scored.withColumn("risk_tier", risk_tier(F.col(probability))).withColumn("action", action)
