"""Fit the three churn classifiers and choose the best."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.storage import ensure_checkpoint_dir, materialise
from bazaarlens.models import boosting, evaluate
from bazaarlens.models.prep import (
    ID,
    INPUTS,
    LABEL,
    SEED,
    Preparation,
    add_balanced_weight,
    add_positive_weight,
    apply_preparation,
    class_weights,
    fit_preparation,
    preparation_stages,
    split,
)
from bazaarlens.models.score import scored_labels

LOGISTIC = "Logistic Regression"
FOREST = "Random Forest"
BOOSTED = "Gradient-Boosted Trees"
SECOND_ORDER = "Second-Order Boosted Trees"


@dataclass(frozen=True)
class ModelSettings:
    """Hyperparameters; the defaults are the published ones."""

    max_iterations: int = 1000
    tolerance: float = 1e-4
    inverse_penalty: float = 1.0
    forest_trees: int = 300
    forest_depth: int = 8
    forest_min_leaf: int = 20
    boosting_rounds: int = 300
    boosting_depth: int = 5
    learning_rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    max_bins: int = 64
    seed: int = SEED
    #: Parts that the training rows are dealt into by their id, at least; a part has at most about ``part_rows`` rows. Trees
    #: draw their rows per part, so the models depend on these numbers, the rows and the seed, and on nothing of the cluster.
    parts: int = 8
    part_rows: int = 60_000


def _fit(stages: list, classifier, train: DataFrame) -> PipelineModel:
    return Pipeline(stages=[*stages, classifier]).fit(train)


def fit_logistic(train: DataFrame, preparation: Preparation, settings: ModelSettings) -> PipelineModel:
    """Balanced logistic regression on scaled inputs with an L2 penalty."""
    weights = class_weights(train).first().asDict()
    rows = weights["negatives"] + weights["positives"]
    classifier = LogisticRegression(
        labelCol=LABEL,
        weightCol="weight",
        maxIter=settings.max_iterations,
        tol=settings.tolerance,
        # Spark divides the loss by the total weight, which balancing keeps at the number of rows.
        regParam=1.0 / (settings.inverse_penalty * rows),
        standardization=False,
    )
    return _fit(preparation_stages(preparation, scale=True), classifier, add_balanced_weight(train, weights))


def fit_forest(train: DataFrame, preparation: Preparation, settings: ModelSettings) -> PipelineModel:
    """Balanced random forest."""
    ensure_checkpoint_dir(train.sparkSession)
    classifier = RandomForestClassifier(
        labelCol=LABEL,
        weightCol="weight",
        numTrees=settings.forest_trees,
        maxDepth=settings.forest_depth,
        minInstancesPerNode=settings.forest_min_leaf,
        maxBins=settings.max_bins,
        seed=settings.seed,
    )
    weighted = add_balanced_weight(train, class_weights(train).first().asDict())
    return _fit(preparation_stages(preparation), classifier, weighted)


def fit_boosted(train: DataFrame, preparation: Preparation, settings: ModelSettings) -> PipelineModel:
    """Gradient-boosted trees, positives weighted by negatives per positive.

    Spark boosts on first-order gradients; :func:`fit_second_order` weighs them by curvature as well.
    """
    ensure_checkpoint_dir(train.sparkSession)
    classifier = GBTClassifier(
        labelCol=LABEL,
        weightCol="weight",
        maxIter=settings.boosting_rounds,
        maxDepth=settings.boosting_depth,
        stepSize=settings.learning_rate,
        subsamplingRate=settings.row_share,
        featureSubsetStrategy=str(settings.column_share),
        maxBins=settings.max_bins,
        seed=settings.seed,
    )
    weighted = add_positive_weight(train, class_weights(train).first().asDict())
    return _fit(preparation_stages(preparation), classifier, weighted)


FITTERS = {LOGISTIC: fit_logistic, FOREST: fit_forest, BOOSTED: fit_boosted}


@dataclass(frozen=True)
class TrainingResult:
    preparation: Preparation
    train: DataFrame
    test: DataFrame
    models: dict[str, PipelineModel]
    scored: dict[str, DataFrame]

    def comparison(self) -> DataFrame:
        return evaluate.compare_models(self.scored)

    def roc_curves(self) -> DataFrame:
        parts = [
            evaluate.roc_curve(scored).select(F.lit(name).alias("model"), "threshold", "fpr", "tpr")
            for name, scored in self.scored.items()
        ]
        curves = parts[0]
        for part in parts[1:]:
            curves = curves.unionByName(part)
        return curves


def best_of(comparison: DataFrame) -> str:
    """Name of the model with the highest ROC AUC."""
    return comparison.orderBy(F.desc("roc_auc"), "model").first()["model"]


def train_models(
    features: DataFrame, settings: ModelSettings = ModelSettings(), names: tuple[str, ...] = tuple(FITTERS)
) -> TrainingResult:
    """Split, fit the preparation on the training rows, fit the models, score the test rows.

    Iterations read the training rows many times, so these are stored once, and so are the test scores. The fits keep the
    rows as they are dealt here, in parts by id and in its order; more rows make more parts, and not larger tasks.
    """
    train, test = split(features, seed=settings.seed)
    train, test = materialise(train, "train"), materialise(test, "test")
    parts = max(settings.parts, -(-train.count() // settings.part_rows))
    train = train.repartition(parts, ID).sortWithinPartitions(ID)
    return add_models(TrainingResult(fit_preparation(train), train, test, {}, {}), names, settings)


def add_models(
    result: TrainingResult, names: tuple[str, ...], settings: ModelSettings = ModelSettings()
) -> TrainingResult:
    """Fit further models on the same rows."""
    models = {name: FITTERS[name](result.train, result.preparation, settings) for name in names}
    scored = {name: materialise(scored_labels(model, result.test), "scored") for name, model in models.items()}
    return replace(result, models=result.models | models, scored=result.scored | scored)


def logistic_gradient(model: PipelineModel, train: DataFrame) -> DataFrame:
    """``feature, gradient`` of the penalised loss at the fitted coefficients; zero at its minimum."""
    classifier = model.stages[-1]
    weights = class_weights(train).first().asDict()
    scored = model.transform(add_balanced_weight(train, weights)).withColumn("p", vector_to_array("probability")[1])
    error = F.col("weight") * (F.col("p") - F.col(LABEL))
    slopes = [(F.sum(error * F.col(f"_in_{c}")) / F.sum("weight")).alias(c) for c in INPUTS]
    penalty = dict(zip(INPUTS, classifier.coefficients.toArray().tolist(), strict=True))
    regular = classifier.getRegParam()
    total = scored.agg(*slopes).select(*[(F.col(c) + F.lit(regular * penalty[c])).alias(c) for c in INPUTS])
    return total.unpivot([], list(INPUTS), "feature", "gradient")


def fit_second_order(
    train: DataFrame, preparation: Preparation, settings: boosting.BoostingSettings = boosting.BoostingSettings()
) -> boosting.BoostedModel:
    """Second-order boosted trees on the prepared inputs, positives weighted by negatives per positive."""
    weight = class_weights(train).first()["scale_pos_weight"] or 1.0
    prepared = materialise(apply_preparation(train, preparation).select(ID, LABEL, *INPUTS), "boosting-inputs")
    return boosting.fit(prepared, weight, settings)


def score_second_order(model: boosting.BoostedModel, preparation: Preparation, features: DataFrame) -> DataFrame:
    """``id, label, prediction, score`` for evaluation, as :func:`scored_labels` gives them for a pipeline."""
    scored = model.score(apply_preparation(features, preparation), keep=(ID, LABEL))
    return scored.select(ID, F.col(LABEL).cast("int").alias("label"), (F.col("score") > 0.5).cast("int").alias("prediction"), "score")


def metrics_row(comparison: DataFrame, name: str) -> DataFrame:
    """The stored metrics of one model."""
    return comparison.filter(F.col("model") == name).select(
        "model", "roc_auc", "f1", "precision", "recall", "accuracy"
    )


def feature_importance(model: PipelineModel, spark, top: int | None = None) -> DataFrame:
    """``feature, importance``, largest first; no rows for the linear model, whose coefficients are no importances."""
    classifier = model.stages[-1]
    values = classifier.featureImportances.toArray().tolist() if hasattr(classifier, "featureImportances") else []
    rows = list(zip(INPUTS, values)) if values else []
    ranked = spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
    return ranked if top is None else ranked.limit(top)
