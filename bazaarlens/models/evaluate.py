"""Evaluation over whole scored tables: ``label`` (0/1), ``prediction`` (0/1) and ``score`` (probability of 1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import half_even
from bazaarlens.functions.ordered import running_totals

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def _ratio(part, whole):
    """A ratio that is zero when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """``label, prediction, customers`` for all four cells, empty ones included."""
    cells = [(actual, predicted) for actual in (0, 1) for predicted in (0, 1)]
    counts = scored.agg(
        *[
            F.count_if((F.col("label") == a) & (F.col("prediction") == p)).alias(f"c{a}{p}")
            for a, p in cells
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("label"), F.lit(p).alias("prediction"), F.col(f"c{a}{p}").alias("customers"))
            for a, p in cells
        ]
    )
    return counts.select(F.inline(rows))


def _cells(scored: DataFrame) -> DataFrame:
    def cell(actual: int, predicted: int):
        return F.count_if((F.col("label") == actual) & (F.col("prediction") == predicted))

    return scored.agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def threshold_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1, as one row."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _cells(scored).select(
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _by_score(scored: DataFrame) -> DataFrame:
    per_score = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives")
    )
    return running_totals(per_score, "score", ["positives", "negatives"])


def roc_curve(scored: DataFrame) -> DataFrame:
    """``threshold, fpr, tpr`` at every distinct score, from the highest down; rows at or above it count as 1."""
    totals = scored.agg(
        F.struct(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    ).scalar()
    return _by_score(scored).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_negatives").cast("double"), totals["n"]).alias("fpr"),
        F.try_divide(F.col("cum_positives").cast("double"), totals["p"]).alias("tpr"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs ranked correctly, equal scores counting half, as one row.

    Counted per distinct score from running totals, so pairs are never made; decimals keep the counts exact.
    """
    positives, negatives, above = (
        F.col(c).cast("decimal(19,0)") for c in ("positives", "negatives", "cum_positives")
    )
    # Twice the correctly ranked pairs: negatives of a score lie below all positives with a higher one.
    twice = negatives * (above - positives) * 2 + negatives * positives
    return _by_score(scored).agg(
        F.try_divide(
            F.sum(twice).cast("double"),
            2.0 * F.sum("positives").cast("double") * F.sum("negatives").cast("double"),
        ).alias("roc_auc")
    )


def binary_metrics(scored: DataFrame) -> DataFrame:
    return threshold_metrics(scored).withColumn("roc_auc", roc_auc(scored).scalar())


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of both classes with macro and weighted averages, and accuracy."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn

    def line(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    active = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp))
    churned = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn))
    n_active, n_churned = tn + fp, tp + fn
    macro = [(a + c) / 2 for a, c in zip(active, churned, strict=True)]
    weighted = [_ratio(a * n_active + c * n_churned, total) for a, c in zip(active, churned, strict=True)]
    accuracy = _ratio(tp + tn, total)
    rows = F.array(
        line("Active", *active, n_active),
        line("Churned", *churned, n_churned),
        line("accuracy", accuracy, accuracy, accuracy, total),
        line("macro avg", *macro, total),
        line("weighted avg", *weighted, total),
    )
    return _cells(scored).select(F.inline(rows))


def compare_models(scored_by_model: dict[str, DataFrame]) -> DataFrame:
    """One row of metrics per model, rounded to 4 decimals, best ROC AUC first."""
    rows = [
        binary_metrics(scored).select(F.lit(name).alias("model"), *[half_even(F.col(m), 4).alias(m) for m in METRICS])
        for name, scored in scored_by_model.items()
    ]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("roc_auc"), "model")
