"""Feature attributions (Shapley values) for whole tables.

Wide attribution tables hold one row per customer: the id, ``base_value`` and one column per model input.
For every row, ``base_value`` plus the attributions is the model output on the scale named by the function.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.functions.columns import half_even, seeded_order
from bazaarlens.functions.storage import scratch_path
from bazaarlens.models.prep import ID, INPUTS, SEED, prepared_inputs

# The function sent to the executors carries this module's code, which need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Customers that one task explains; it works out the tables over the patterns of all leaves once.
ROWS_PER_TASK = 8_192

# Bytes of the work arrays and of the pattern tables of one step.
WORK_SIZE = 16_000_000
# Rows whose patterns are looked up together.
ROW_BLOCK = 2_048
# Inputs on a path from which on a table over all their patterns would outgrow a step.
PATTERN_INPUTS = 10


def linear_attributions(
    df: DataFrame, coefficients: Mapping[str, float], intercept: float = 0.0, background: DataFrame | None = None
) -> DataFrame:
    """Log-odds attributions of a linear model: coefficient times distance from the background mean.

    ``df`` holds the id and the inputs as the model sees them. Without a background the means are zero, as those of scaled
    inputs are over the training rows: a customer's values then don't depend on who else is in the table.
    """
    if background is None:
        values = [(F.lit(float(k)) * F.col(c)).alias(c) for c, k in coefficients.items()]
        return df.select(ID, F.lit(float(intercept)).alias("base_value"), *values)
    means = F.struct(*[F.avg(c).alias(c) for c in coefficients])
    # One aggregate for all means; Spark runs an identical scalar subquery once.
    mean_of = background.agg(means).scalar()
    base = F.lit(float(intercept))
    for name, coefficient in coefficients.items():
        base = base + F.lit(float(coefficient)) * mean_of[name]
    values = [(F.lit(float(k)) * (F.col(c) - mean_of[c])).alias(c) for c, k in coefficients.items()]
    return df.select(ID, base.alias("base_value"), *values)


@dataclass(frozen=True)
class LeafGroup:
    """Leaves with the same number ``d`` of distinct features on their path, as (leaves, d) arrays.

    A row reaches a leaf when every ``low < x[feature] <= high``; ``share`` is the part of the training rows that
    stays on the path at the splits of that feature.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Ensemble:
    """A fitted tree ensemble as plain arrays; its size depends on the model settings and not on the data."""

    groups: tuple[LeafGroup, ...]
    base_value: float


def _leaf_paths(nodes: Mapping[int, Mapping], value_of, cover_of) -> Iterator[tuple[dict, float]]:
    """Walk one tree: per leaf the interval and share of every feature on the path, and its value."""
    pending = [(0, {})]
    while pending:
        node_id, path = pending.pop()
        node = nodes[node_id]
        if node["leftChild"] < 0:
            yield path, value_of(node)
            continue
        feature = node["split"]["featureIndex"]
        threshold = node["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in (
            (node["leftChild"], (low, min(high, threshold))),
            (node["rightChild"], (max(low, threshold), high)),
        ):
            part = cover_of(nodes[child]) / cover_of(node)
            pending.append((child, path | {feature: (*bounds, share * part)}))


def read_ensemble(model: PipelineModel, spark: SparkSession) -> Ensemble:
    """Read the trees of the classifier stage from its saved form."""
    classifier = model.stages[-1]
    path = scratch_path(spark, "trees")
    classifier.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    forest = isinstance(classifier, RandomForestClassificationModel)
    weights = classifier.treeWeights
    total = sum(weights) if forest else 1.0

    def value_of(node) -> float:
        stats = node["impurityStats"]
        return weights[node["treeID"]] / total * (stats[1] / sum(stats) if forest else node["prediction"])

    def cover_of(node) -> float:
        # Weighted rows: the class counts of a classification node, the first statistic of a regression node.
        stats = node["impurityStats"]
        return sum(stats) if forest else stats[0]

    leaves = []
    for _, rows in groupby(saved, key=lambda r: r["treeID"]):
        leaves.extend(_leaf_paths({r["id"]: r for r in rows}, value_of, cover_of))
    return ensemble_from_leaves(leaves)


def ensemble_from_leaves(leaves: Sequence[tuple[dict, float]]) -> Ensemble:
    base = sum(value * np.prod([share for *_, share in path.values()]) for path, value in leaves)
    groups = []
    for size in sorted({len(path) for path, _ in leaves} - {0}):
        same = [(path, value) for path, value in leaves if len(path) == size]
        bounds = np.array([list(path.values()) for path, _ in same])
        groups.append(
            LeafGroup(
                feature=np.array([list(path) for path, _ in same]),
                low=bounds[:, :, 0],
                high=bounds[:, :, 1],
                share=bounds[:, :, 2],
                value=np.array([value for _, value in same]),
            )
        )
    return Ensemble(tuple(groups), float(base))


def _weights_of(known: np.ndarray, group: LeafGroup, part: slice) -> np.ndarray:
    """Shapley values of the leaves of ``part`` for 0/1 arrays ``known`` whose last two axes are leaf and input.

    In a leaf's game a known feature contributes 1 or 0 (the row stays on the path or leaves it) and an unknown one
    its share. The Shapley weight k!(d-1-k)!/d! is the integral of t^k (1-t)^(d-1-k), so a feature's value is
    (known - share) times the integral over t of the product of the other features' mixes; that integrand has degree
    d-1, which Gauss-Legendre quadrature with d/2 points integrates exactly.
    """
    share = group.share[part]
    points, weights = np.polynomial.legendre.leggauss((share.shape[1] + 1) // 2)
    integral = np.zeros(np.broadcast_shapes(known.shape, share.shape))
    for t, weight in zip((points + 1) / 2, weights / 2, strict=True):
        mix = share * (1 - t) + known * t
        integral += weight * mix.prod(axis=-1, keepdims=True) / mix
    return (known - share) * integral * group.value[part, None]


def _pattern_tables(group: LeafGroup, part: slice, width: int) -> np.ndarray:
    """The values of all inputs for every pattern of known ones, by (leaf, pattern, input)."""
    leaves, size = group.feature[part].shape
    known = (np.arange(1 << size)[:, None, None] >> np.arange(size) & 1).astype(float)
    values = _weights_of(known, group, part)
    tables = np.zeros((leaves, 1 << size, width))
    tables[np.arange(leaves)[:, None, None], np.arange(1 << size)[None, :, None], group.feature[part][:, None, :]] = values.transpose(1, 0, 2)
    return tables


def _on_path(columns: np.ndarray, group: LeafGroup, part: slice) -> np.ndarray:
    """Whether each row (last axis) stays on the path at the splits of each input, by (leaf, input, row)."""
    values = columns[group.feature[part]]
    return (values > group.low[part][:, :, None]) & (values <= group.high[part][:, :, None])


def _bounds(group: LeafGroup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (input, bound) pairs of a group, and by (leaf, input) the numbers of its lower and upper bound.

    Trees split at few distinct places, so rows are compared once with each of these and not once with each leaf.
    """
    pairs = np.stack([np.tile(group.feature.ravel(), 2).astype(float), np.concatenate([group.low.ravel(), group.high.ravel()])], axis=1)
    distinct, number = np.unique(pairs, axis=0, return_inverse=True)
    low, high = number.reshape(2, *group.feature.shape)
    return distinct[:, 0].astype(np.intp), distinct[:, 1], low, high


def shapley_values(ensemble: Ensemble, x: np.ndarray) -> np.ndarray:
    """Exact path-dependent Shapley values for the rows of ``x``.

    What a row gets from a leaf depends only on which inputs of its path keep it there. With few inputs on the path that
    is a number of ``d`` bits, so the values of all patterns are worked out once for each leaf and rows look theirs up.
    """
    rows, width = x.shape
    out = np.zeros((rows, width))
    columns = np.ascontiguousarray(x.T, dtype=float)
    for group in ensemble.groups:
        leaves, size = group.feature.shape
        patterned = size < PATTERN_INPUTS and rows >= 1 << size
        block = ROW_BLOCK if patterned else max(1, WORK_SIZE // (64 * leaves * size))
        step = max(1, WORK_SIZE // (8 * max(width << size, size * ROW_BLOCK))) if patterned else leaves
        if patterned:
            inputs, bounds, low, high = _bounds(group)
            # all bits set where a row is on that side of a bound
            within, beyond = (-(side.astype(np.int16)) for side in (columns[inputs] <= bounds[:, None], columns[inputs] > bounds[:, None]))
            bits = [np.int16(1 << j) for j in range(size)]
            found, held, patterns = np.empty((block, width)), np.empty(block, np.int16), np.empty(block, np.int16)
        for first in range(0, leaves, step):
            part = slice(first, min(first + step, leaves))
            if not patterned:
                for a in range(0, rows, block):
                    known = _on_path(columns[:, a : a + block], group, part)
                    values = _weights_of(known.transpose(2, 0, 1).astype(float), group, part)
                    for j in range(size):
                        np.add.at(out[a : a + block].T, group.feature[part][:, j], values[:, :, j].T)
                continue
            tables = _pattern_tables(group, part, width)
            for a in range(0, rows, block):
                own = out[a : a + block]
                on, pattern = held[: len(own)], patterns[: len(own)]
                inside, outside = within[:, a : a + block], beyond[:, a : a + block]
                for table, lows, highs in zip(tables, low[part].tolist(), high[part].tolist(), strict=True):
                    pattern.fill(0)
                    for bit, lower, upper in zip(bits, lows, highs, strict=True):
                        np.bitwise_and(inside[upper], outside[lower], out=on)
                        on &= bit
                        pattern |= on
                    own += table.take(pattern, axis=0, out=found[: len(own)], mode="clip")
    return out


def tree_attributions(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Attributions of a tree ensemble for every customer, computed batch by batch inside the partitions.

    The forest's values are on the probability scale. The boosted model's are on the margin scale, where the
    probability is the logistic function of twice the margin.
    """
    spark = features.sparkSession
    ensemble = read_ensemble(model, spark)
    return ensemble_attributions(ensemble, in_tasks(prepared_inputs(model, features), features.count()))


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, dealt by id for its attributions: rows are few bytes but much work, so tasks are sized by rows."""
    return df.repartition(-(-rows // ROWS_PER_TASK) or 1, ID)


def _batches_of(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in batches of at least ``rows``, the last one excepted."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def ensemble_attributions(ensemble: Ensemble, df: DataFrame, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """Attributions of an ensemble whose features are numbered as ``inputs``, columns of ``df`` beside the id."""
    columns = list(inputs)

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches_of(batches, ROWS_PER_TASK):
            values = shapley_values(ensemble, batch[columns].to_numpy(dtype=float))
            out = pd.DataFrame(values, columns=columns)
            out.insert(0, "base_value", ensemble.base_value)
            out.insert(0, ID, batch[ID].to_numpy())
            yield out

    schema = T.StructType(
        [df.schema[ID], T.StructField("base_value", T.DoubleType())]
        + [T.StructField(c, T.DoubleType()) for c in columns]
    )
    return df.select(ID, *columns).mapInPandas(attribute, schema)


def attributions(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Attributions of any of the fitted models: log-odds for the linear one, see above for the trees."""
    classifier = model.stages[-1]
    if not isinstance(classifier, LogisticRegressionModel):
        return tree_attributions(model, features)
    scaled = prepared_inputs(model, features)
    coefficients = dict(zip(INPUTS, classifier.coefficients.toArray().tolist(), strict=True))
    return linear_attributions(scaled, coefficients, classifier.intercept)


def long_form(attributions: DataFrame, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """``id, feature, value`` rows."""
    return attributions.unpivot([ID], list(inputs), "feature", "value")


def top_attributions(attributions: DataFrame, limit: int = 8, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """The ``limit`` strongest attributions of every customer, largest value first, rounded to 4 decimals.

    Chosen inside each row from an array of its values, so nothing is shuffled.
    """
    def cell(name: str) -> Column:
        value = F.col(name)
        return F.struct((-F.abs(value)).alias("weakness"), F.lit(name).alias("feature"), value.alias("value"))

    strongest = F.slice(F.array_sort(F.array(*[cell(c) for c in inputs])), 1, limit)
    by_value = F.array_sort(
        F.transform(
            strongest,
            lambda s: F.struct((-s["value"]).alias("order"), s["feature"].alias("feature"), s["value"].alias("value")),
        )
    )
    return (
        attributions.select(ID, F.posexplode(by_value).alias("position", "item"))
        .select(
            ID,
            (F.col("position") + 1).alias("position"),
            F.col("item.feature").alias("feature"),
            half_even(F.col("item.value"), 4).alias("value"),
        )
    )


def attribution_sample(test: DataFrame, size: int = 500, seed: int = SEED) -> DataFrame:
    """The test rows that the global summary looks at; the same ones for a seed."""
    return test.orderBy(seeded_order(F.col(ID), seed), ID).limit(size)


def global_attributions(attributions: DataFrame, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """Mean absolute attribution per feature, largest first; one aggregate and no long form of the table."""
    return (
        attributions.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in inputs])
        .unpivot([], list(inputs), "feature", "mean_abs_value")
        .orderBy(F.desc("mean_abs_value"), "feature")
    )
