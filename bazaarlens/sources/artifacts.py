"""Write and read back the derived artefacts: feature table, reports, metrics, importances, models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Artefact names.
FEATURES = "customer_features"
MODEL = "churn_model"
METRICS = "model_metrics"
IMPORTANCE = "feature_importance"
CLASSIFICATION = "classification_report"

FEATURE_SCHEMA = """
    customer_unique_id STRING, total_spend DOUBLE, total_products BIGINT, distinct_categories BIGINT,
    distinct_sellers BIGINT, num_orders BIGINT, avg_delivery_days DOUBLE, avg_review_score DOUBLE,
    pct_delayed DOUBLE, weekend_purchase_ratio DOUBLE, state STRING, city STRING,
    days_since_first_purchase BIGINT, days_since_last_purchase BIGINT, customer_lifetime_days BIGINT,
    preferred_payment_method STRING, avg_order_value DOUBLE, avg_basket_size DOUBLE,
    purchase_frequency DOUBLE, avg_freight_ratio DOUBLE, churn INT
"""


def write_report(report: DataFrame, path: str) -> None:
    """Export a report as CSV with a header. Its rows are written as Spark partitions them."""
    report.write.mode("overwrite").option("header", True).csv(path)


def write_features(features: DataFrame, folder: str) -> None:
    """Store the feature table as Parquet, and as CSV derived from the stored Parquet."""
    parquet = f"{folder}/{FEATURES}.parquet"
    features.write.mode("overwrite").parquet(parquet)
    write_report(features.sparkSession.read.schema(features.schema).parquet(parquet), f"{folder}/{FEATURES}.csv")


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet if it is there, else CSV, else an error."""
    try:
        return spark.read.parquet(f"{folder}/{FEATURES}.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    try:
        return spark.read.schema(FEATURE_SCHEMA).option("header", True).csv(f"{folder}/{FEATURES}.csv")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    raise FileNotFoundError(f"no feature table in {folder}; build the customer features first")


def save_model(model: PipelineModel, folder: str) -> None:
    model.write().overwrite().save(f"{folder}/{MODEL}")


_loaded_models: dict[tuple[str, str], tuple[tuple, PipelineModel]] = {}


def load_model(spark: SparkSession, folder: str) -> PipelineModel:
    """Load the fitted pipeline, once per application and folder until another one is stored there."""
    key = (spark.sparkContext.applicationId, folder)
    try:
        stamp = tuple(spark.read.json(f"{folder}/{MODEL}/metadata").select("uid", "timestamp").first())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no model in {folder}; train one first") from error
    if key not in _loaded_models or _loaded_models[key][0] != stamp:
        _loaded_models[key] = (stamp, PipelineModel.load(f"{folder}/{MODEL}"))
    return _loaded_models[key][1]


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """One JSON row with model name and rounded scores."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/{METRICS}")


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The stored metrics row, or no rows when no model was trained."""
    schema = "model STRING, roc_auc DOUBLE, f1 DOUBLE, precision DOUBLE, recall DOUBLE, accuracy DOUBLE"
    return _read_or_empty(spark, schema, lambda r: r.json(f"{folder}/{METRICS}"))


def write_importance(importance: DataFrame, folder: str) -> None:
    """Feature importances, largest first; one row per model input, so one file."""
    write_report(importance.orderBy(F.desc("importance"), "feature").coalesce(1), f"{folder}/{IMPORTANCE}")


def write_classification(report: DataFrame, folder: str) -> None:
    """Precision, recall, F1 and support by class: a few rows, so one file."""
    write_report(report.coalesce(1), f"{folder}/{CLASSIFICATION}")


def read_importance(spark: SparkSession, folder: str) -> DataFrame:
    schema = "feature STRING, importance DOUBLE"
    return _read_or_empty(spark, schema, lambda r: r.option("header", True).csv(f"{folder}/{IMPORTANCE}"))


def _read_or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    try:
        return read(spark.read.schema(schema))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
