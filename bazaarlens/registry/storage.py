"""Reading and writing: each query stores what it reads from the given tables, reads it back, and returns all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.storage import scratch_path
from bazaarlens.models import evaluate, score, train
from bazaarlens.operators import filters, reports
from bazaarlens.operators.features import FEATURE_COLUMNS
from bazaarlens.operators.filters import Filters
from bazaarlens.registry.base import CHOSEN, FILTERED
from bazaarlens.registry.core import ORACLE, Source, register
from bazaarlens.registry.models import scores, trained
from bazaarlens.registry.quality import VIEW_OF
from bazaarlens.sources import artifacts, clustered
from bazaarlens.sources.catalog import CATALOG
from bazaarlens.sources.tables import CommerceTables, read_csv_table, read_tables, write_tables


def _csv(s: Source, name: str) -> DataFrame:
    """A table through CSV files whose columns stand in another order than declared, with one more."""
    path = scratch_path(s.spark, "csv")
    table = getattr(s.tables, name)
    table.select(*reversed(table.columns), F.lit(1).alias("more")).write.option("header", True).csv(path)
    return read_csv_table(s.spark, path, CATALOG[name])


register(
    "s01_csv_payments",
    lambda s: _csv(s, "payments").select(
        F.col("order_id").cast("bigint"), "payment_sequential", "payment_type", "payment_installments",
        F.col("payment_value").cast("double"),
    ),
    "SELECT order_id, payment_sequential, payment_type, payment_installments, CAST(payment_value AS DOUBLE) AS payment_value "
    "FROM v_payments",
)
register(
    "s01_csv_sellers",
    lambda s: _csv(s, "sellers").withColumn("seller_id", F.col("seller_id").cast("bigint")),
    "SELECT seller_id, seller_zip_code_prefix, seller_city, seller_state FROM v_sellers",
)


def _stored_tables(s: Source) -> DataFrame:
    """Payments under the declared types, by way of the stored catalog."""
    folder = scratch_path(s.spark, "tables")
    spec = CATALOG["payments"]
    typed = s.tables.payments.select(*[F.col(f.name).cast(f.dataType) for f in spec.schema.fields])
    write_tables(CommerceTables(payments=typed), folder)
    return read_tables(s.spark, folder).payments


register(
    "s02_stored_payments",
    lambda s: _stored_tables(s).withColumn("payment_value", F.col("payment_value").cast("double")),
    "SELECT CAST(order_id AS VARCHAR) AS order_id, payment_sequential, payment_type, payment_installments, "
    "CAST(payment_value AS DOUBLE) AS payment_value FROM v_payments",
)


_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP"}


def _stored(s: Source, name: str) -> DataFrame:
    """One table under its declared types, by way of the stored catalog; money as doubles."""
    folder, table, spec = scratch_path(s.spark, "tables"), getattr(s.tables, name), CATALOG[name]
    there = [f for f in spec.schema.fields if f.name in table.columns]
    write_tables(CommerceTables(**{name: table.select(*[F.col(f.name).cast(f.dataType) for f in there])}), folder)
    stored = getattr(read_tables(s.spark, folder), name).select(*[f.name for f in there])
    return stored.select(*[F.col(c).cast("double") if kind.startswith("decimal") else F.col(c) for c, kind in stored.dtypes])


def _stored_sql(name: str, columns: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in CATALOG[name].schema.fields}
    casts = [f"CAST({c} AS {_SQL_TYPES.get(kinds[c], 'DOUBLE')}) AS {c}" for c in columns.split()]
    return f"SELECT {', '.join(casts)} FROM {VIEW_OF[name]}"


# the columns that the test tables have
for _name, _columns in {
    "customers": "customer_id customer_unique_id customer_zip_code_prefix customer_city customer_state",
    "sellers": "seller_id seller_zip_code_prefix seller_city seller_state",
    "product_category_translation": "product_category_name product_category_name_english",
    "products": "product_id product_category_name",
    "orders": "order_id customer_id order_status order_purchase_timestamp order_delivered_customer_date "
    "order_estimated_delivery_date",
    "order_items": "order_id order_item_id product_id seller_id price freight_value",
    "reviews": "review_id order_id review_score",
}.items():
    register(f"s02_stored_{_name}", lambda s, n=_name: _stored(s, n), _stored_sql(_name, _columns))


def _clustered(s: Source) -> DataFrame:
    """All item rows by way of the table that the dashboard's date filter reads."""
    path = scratch_path(s.spark, "items")
    table = f"clustered_{path.rsplit('-', 1)[1]}"
    return clustered.store_items(s.items(), table, path, 8)


register(
    "b01_clustered_months",
    lambda s: _clustered(s).groupBy("month").agg(F.count("*").alias("items"), F.countDistinct("order_id").alias("orders")),
    "SELECT month, COUNT(*) AS items, COUNT(DISTINCT order_id) AS orders FROM v_wide GROUP BY month",
)
register(
    "c10_clustered_date_filter",
    lambda s: filters.apply_filters(_clustered(s), Filters(date_range=CHOSEN.date_range)).select(*FILTERED),
)
ORACLE["c10_clustered_date_filter"] = ORACLE["c10_date_filter"]


def _features(s: Source) -> DataFrame:
    folder = scratch_path(s.spark, "features")
    artifacts.write_features(s.features, folder)
    return artifacts.read_features(s.spark, folder)


register("s07_stored_features", lambda s: _features(s).select(*FEATURE_COLUMNS))
ORACLE["s07_stored_features"] = ORACLE["f21_customer_features"]


def _features_from_csv(s: Source) -> DataFrame:
    """The reader falls back to the CSV where there is no Parquet."""
    folder = scratch_path(s.spark, "features")
    artifacts.write_report(s.features, f"{folder}/{artifacts.FEATURES}.csv")
    kinds = dict(s.features.dtypes)
    return artifacts.read_features(s.spark, folder).select(*[F.col(c).cast(kinds[c]) for c in FEATURE_COLUMNS])


register("s08_features_from_csv", _features_from_csv)
ORACLE["s08_features_from_csv"] = ORACLE["f21_customer_features"]


def _report(s: Source) -> DataFrame:
    path = scratch_path(s.spark, "report")
    report = reports.monthly_revenue(s.tables)
    artifacts.write_report(report, path)
    return s.spark.read.schema(report.schema).option("header", True).csv(path)


register("s09_report_csv", _report)
ORACLE["s09_report_csv"] = ORACLE["q02_monthly_revenue"]


def _reloaded_model(s: Source) -> DataFrame:
    """Per customer: the loaded model gives the label and probability of the fitted one."""
    folder = scratch_path(s.spark, "model")
    model = trained(s, train.FOREST).models[train.FOREST]
    artifacts.save_model(model, folder)
    mine = score.predict_churn(model, s.stored_features)
    theirs = score.predict_churn(artifacts.load_model(s.spark, folder), s.stored_features)
    both = mine.alias("m").join(theirs.alias("t"), "customer_unique_id")
    same = (F.col("m.label") == F.col("t.label")) & (F.col("m.churn_probability") == F.col("t.churn_probability"))
    return both.select("customer_unique_id", same.alias("agrees"))


register("s10_reloaded_model", _reloaded_model, "SELECT customer_unique_id, TRUE AS agrees FROM v_features")


def _metrics(s: Source) -> DataFrame:
    folder = scratch_path(s.spark, "metrics")
    artifacts.write_metrics(train.metrics_row(evaluate.compare_models(scores(s)), "fast"), folder)
    return artifacts.read_metrics(s.spark, folder)


register("s11_metrics_json", _metrics)
ORACLE["s11_metrics_json"] = f"SELECT * FROM ({ORACLE['m14_score_comparison']}) WHERE model = 'fast'"


def _importance(s: Source) -> DataFrame:
    """Importances through their file: as many, none negative, in order, and one in sum."""
    folder = scratch_path(s.spark, "importance")
    artifacts.write_importance(train.feature_importance(trained(s, train.FOREST).models[train.FOREST], s.spark), folder)
    return artifacts.read_importance(s.spark, folder).agg(
        F.count("*").alias("features"),
        (F.min("importance") >= 0).alias("none_negative"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_is_one"),
    )


register("s12_importance_csv", _importance)
ORACLE["s12_importance_csv"] = ORACLE["m15_importance_is_a_share"]
