"""The batch run: load the tables, build the feature table, train, and store what the pages need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.functions.storage import materialise
from bazaarlens.models import evaluate, explain, train
from bazaarlens.operators import features, profile, quality
from bazaarlens.operators.base import order_items_wide
from bazaarlens.sources import artifacts, clustered
from bazaarlens.sources.tables import CommerceTables, read_csv_tables, read_tables, write_tables

ITEMS_TABLE = "shop_items"


def load(spark: SparkSession, csv_folder: str, table_folder: str, files=None) -> CommerceTables:
    """CSV files to typed Parquet tables; files that are missing are skipped."""
    write_tables(read_csv_tables(spark, csv_folder, files), table_folder)
    return read_tables(spark, table_folder)


def validate(tables: CommerceTables) -> dict[str, DataFrame]:
    """Row counts and the checks of the declared keys, references and mandatory columns."""
    return {
        "row_counts": quality.row_counts(tables),
        "duplicate_keys": quality.duplicate_key_counts(tables),
        "orphans": quality.orphan_counts(tables),
        "missing_mandatory": quality.missing_mandatory(tables),
    }


def build_features(tables: CommerceTables, folder: str, churn_days: int = features.CHURN_DAYS) -> DataFrame:
    """Build the feature table, store it, and read it back."""
    built = features.features_from_tables(tables, churn_days)
    artifacts.write_features(built, folder)
    return artifacts.read_features(built.sparkSession, folder)


def describe(table: DataFrame) -> dict[str, DataFrame]:
    """The exploratory tables of the stored feature table."""
    return {
        "summary": profile.dataset_summary(table),
        "missing_values": quality.missing_values(table),
        "churn_split": profile.churn_split(table),
        "review_distribution": profile.review_distribution(table),
        "spend_histogram": profile.spend_histogram(table, 80),
        "orders_distribution": profile.orders_distribution(table),
        "churn_by_state": profile.churn_by_state(table),
        "correlation_matrix": profile.correlation_matrix(table),
    }


@dataclass(frozen=True)
class ModelReport:
    """What a training run leaves behind, next to the stored model, metrics and importances."""

    best: str
    result: train.TrainingResult
    comparison: DataFrame
    roc_curves: DataFrame
    confusion: dict[str, DataFrame]
    classification: DataFrame
    importance: DataFrame
    attributions: DataFrame


def train_and_store(
    table: DataFrame, folder: str, settings: train.ModelSettings = train.ModelSettings()
) -> ModelReport:
    """Train the classifiers, keep the one with the highest ROC AUC, and store its artefacts."""
    spark = table.sparkSession
    result = train.train_models(table, settings)
    # A few rows that cost several passes over the scores, and are used several times.
    comparison = materialise(result.comparison(), "comparison")
    best = train.best_of(comparison)
    model = result.models[best]
    artifacts.save_model(model, folder)
    artifacts.write_metrics(train.metrics_row(comparison, best), folder)
    importance = train.feature_importance(model, spark)
    # without rows for the linear model, so that an earlier run's file does not stay next to it
    artifacts.write_importance(importance, folder)
    classification = evaluate.classification_report(result.scored[best])
    artifacts.write_classification(classification, folder)
    return ModelReport(
        best=best,
        result=result,
        comparison=comparison,
        roc_curves=result.roc_curves(),
        confusion={name: evaluate.confusion_matrix(scored) for name, scored in result.scored.items()},
        classification=classification,
        importance=importance,
        attributions=explain.global_attributions(explain.attributions(model, result.test)),
    )


def run(
    spark: SparkSession, csv_folder: str, out_folder: str, files=None, items_table: str = ITEMS_TABLE, buckets: int | None = None
) -> ModelReport:
    """Everything in order, from CSV files to the stored model, with the reports of the checks and of the features.

    The item rows that the pages read are left as ``items_table``, by month and in ``buckets`` buckets of orders (as many as
    the session has shuffle partitions, if none are named).
    """
    tables = load(spark, csv_folder, f"{out_folder}/tables", files)
    for name, report in validate(tables).items():
        artifacts.write_report(report, f"{out_folder}/checks/{name}")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    clustered.store_items(order_items_wide(tables), items_table, f"{out_folder}/items", buckets)
    table = build_features(tables, out_folder)
    for name, report in describe(table).items():
        artifacts.write_report(report, f"{out_folder}/description/{name}")
    return train_and_store(table, out_folder)
