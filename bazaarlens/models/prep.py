"""Model inputs: leakage-safe columns, imputation, encoding, scaling, split and class weights.

The fitted numbers (medians, modes, codes, means, deviations) become built-in stages, ``SQLTransformer`` and
``StringIndexerModel``: scoring stays in the JVM and a saved pipeline needs no Python class to load.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import seeded_order
from bazaarlens.functions.ordered import exact_medians, order_statistics

SEED = 42
TEST_SHARE = 0.2
LABEL = "churn"
ID = "customer_unique_id"

# Columns that identify a customer or give the label away, and the two kinds of model inputs.
LEAKAGE_COLUMNS = (
    "customer_unique_id",
    "city",
    "days_since_last_purchase",
    "days_since_first_purchase",
    "purchase_frequency",
)
NUMERIC_INPUTS = (
    "total_spend",
    "total_products",
    "distinct_categories",
    "distinct_sellers",
    "num_orders",
    "avg_delivery_days",
    "avg_review_score",
    "pct_delayed",
    "weekend_purchase_ratio",
    "customer_lifetime_days",
    "avg_order_value",
    "avg_basket_size",
    "avg_freight_ratio",
)
CATEGORICAL_INPUTS = ("state", "preferred_payment_method")
INPUTS = NUMERIC_INPUTS + CATEGORICAL_INPUTS


def model_inputs(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop the leakage columns; ``keep`` brings single ones back, such as the id to carry through scoring."""
    return features.drop(*[c for c in LEAKAGE_COLUMNS if c not in keep])


def medians(train: DataFrame, columns: Sequence[str] = NUMERIC_INPUTS) -> dict[str, float | None]:
    """Exact medians of the numeric inputs."""
    return exact_medians(train, columns)


def modes(train: DataFrame, columns: Sequence[str] = CATEGORICAL_INPUTS) -> dict[str, str | None]:
    """Most frequent value per categorical input; the smaller value wins a tie."""
    return {c: _most_frequent(train, c) for c in columns}


def _most_frequent(train: DataFrame, column: str) -> str | None:
    counts = train.dropna(subset=[column]).groupBy(column).count()
    top = counts.orderBy(F.desc("count"), column).first()
    return top[column] if top else None


def category_codes(train: DataFrame, column: str, fill: str | None) -> dict[str, int]:
    """Codes 0, 1, ... by sorted value, after missing values are filled."""
    values = train.select(F.coalesce(F.col(column), F.lit(fill)).alias("v")).dropna().distinct().orderBy("v").collect()
    return {row["v"]: code for code, row in enumerate(values)}


@dataclass(frozen=True)
class Preparation:
    """What was learned from the training rows."""

    medians: Mapping[str, float | None]
    modes: Mapping[str, str | None]
    codes: Mapping[str, Mapping[str, int]]
    means: Mapping[str, float]
    deviations: Mapping[str, float]


def fit_preparation(train: DataFrame) -> Preparation:
    mode_of = modes(train)
    codes = {c: category_codes(train, c, mode_of[c]) for c in CATEGORICAL_INPUTS}
    partial = Preparation(medians(train), mode_of, codes, {}, {})
    row = apply_preparation(train, partial).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in INPUTS],
        *[F.stddev_pop(c).alias(f"dev_{c}") for c in INPUTS],
    ).first()
    return Preparation(
        partial.medians,
        partial.modes,
        partial.codes,
        {c: row[f"mean_{c}"] for c in INPUTS},
        {c: row[f"dev_{c}"] for c in INPUTS},
    )


def apply_preparation(df: DataFrame, preparation: Preparation, scale: bool = False) -> DataFrame:
    """The prepared inputs next to whatever other columns ``df`` has.

    A missing number is imputed, a category becomes its code, and -1 stands for a category not seen in training. Scaled
    inputs are centred, in units of the population deviation; a constant column is only centred.
    """
    prepared = PipelineModel(preparation_stages(preparation, scale)[:-1]).transform(df)
    return prepared.withColumns({c: F.col(f"_in_{c}") for c in INPUTS}).select(df.columns)


def prepared_inputs(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The id and the inputs as the classifier of a fitted pipeline sees them."""
    prepared = PipelineModel(model.stages[:-2]).transform(df)
    return prepared.select(ID, *[F.col(f"_in_{c}").alias(c) for c in INPUTS])


def _literal(value: float | str) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST('{value!r}' AS DOUBLE)"


def _project(parts: Mapping[str, str]) -> SQLTransformer:
    columns = ", ".join(f"{text} AS {name}" for name, text in parts.items())
    return SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")


def preparation_stages(preparation: Preparation, scale: bool = False) -> list:
    """The preparation as pipeline stages that end in the vector column ``features``."""
    known = [c for c in CATEGORICAL_INPUTS if preparation.codes[c]]
    modes = preparation.modes
    texts = {f"_text_{c}": f"coalesce({c}, {_literal(modes[c])})" if modes[c] is not None else c for c in known}
    inputs = {}
    for name in INPUTS:
        if name in known:
            # the indexer gives values it does not know the number after the last one
            text = f"CASE WHEN _code_{name} < {len(preparation.codes[name])} THEN _code_{name} ELSE CAST(-1 AS DOUBLE) END"
        elif name in CATEGORICAL_INPUTS:
            text = "CAST(-1 AS DOUBLE)"
        else:
            # A column without any value in training carries no information: it becomes zero.
            median = preparation.medians[name]
            text = f"coalesce(CAST({name} AS DOUBLE), {_literal(float(median or 0.0))})"
        if scale:
            mean, deviation = preparation.means[name], preparation.deviations[name] or 1.0
            text = f"({text} - {_literal(float(mean))}) / {_literal(float(deviation))}"
        inputs[f"_in_{name}"] = text
    stages = [_project(inputs), VectorAssembler(inputCols=list(inputs), outputCol="features")]
    if known:
        codes = [list(preparation.codes[c]) for c in known]
        columns = {"inputCols": list(texts), "outputCols": [f"_code_{c}" for c in known]}
        indexer = StringIndexerModel.from_arrays_of_labels(codes, handleInvalid="keep", **columns)
        stages = [_project(texts), indexer, *stages]
    return stages


def _split_key(seed: int) -> Column:
    # 13 hex digits are 52 bits, which a double holds exactly.
    return F.conv(F.substring(seeded_order(F.col(ID), seed), 1, 13), 16, 10).cast("double")


def mark_test_rows(features: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: the ``share`` of each class with the smallest seeded hash of the id.

    The cut per class is an exact order statistic of the hash, so class sizes are exact, and the rows are chosen
    by a filter: nothing is sorted or gathered per class.
    """
    key = _split_key(seed)
    per_class = {str(label): F.when(F.col(LABEL) == label, key) for label in (0, 1)}

    def last_test_rank(_: str, rows: int) -> list[int]:
        wanted = int(share * rows + 0.5)
        return [wanted - 1] if wanted else []

    cuts = order_statistics(features, per_class, last_test_rank)
    is_test = F.lit(False)
    for label, cut in cuts.items():
        if cut:
            is_test = F.when(F.col(LABEL) == int(label), key <= F.lit(cut[0])).otherwise(is_test)
    return features.withColumn("is_test", is_test)


def split(features: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Stratified training and test rows."""
    marked = mark_test_rows(features, share, seed)
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weight of each class, ``rows / (2 * class rows)``, and negatives per positive, as one row."""
    negative, positive = F.count_if(F.col(LABEL) == 0), F.count_if(F.col(LABEL) == 1)
    rows = (negative + positive).cast("double")
    return train.agg(
        negative.alias("negatives"),
        positive.alias("positives"),
        F.try_divide(rows, 2.0 * negative).alias("weight_0"),
        F.try_divide(rows, 2.0 * positive).alias("weight_1"),
        F.try_divide(negative.cast("double"), positive.cast("double")).alias("scale_pos_weight"),
    )


def add_balanced_weight(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    return df.withColumn(
        "weight", F.when(F.col(LABEL) == 1, F.lit(weights["weight_1"])).otherwise(F.lit(weights["weight_0"]))
    )


def add_positive_weight(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    return df.withColumn(
        "weight", F.when(F.col(LABEL) == 1, F.lit(weights["scale_pos_weight"])).otherwise(F.lit(1.0))
    )
