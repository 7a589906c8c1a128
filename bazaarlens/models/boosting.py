"""Second-order gradient boosting of a logistic loss.

Inputs become bins at quantiles. For each level of a tree one Spark job sums the gradients and curvatures of the
training rows by (node, input, bin): only of the lighter child of each split, the other is its parent less that one. The
executors hold the rows with their margins, to which each tree is added once. The driver, which sees at most nodes x inputs x bins sums, chooses the splits by regularised gain. Where the training rows are
few enough for one task, that task makes the same sums and grows the same trees by itself.

Gradients are rounded to whole multiples of 1 / GRAIN before they are summed, so a model depends on the rows, the settings
and the seed, and not on how the rows are partitioned.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.functions.storage import materialise
from bazaarlens.models.explain import Ensemble, ensemble_from_leaves
from bazaarlens.models.prep import ID, INPUTS, LABEL, SEED

# The functions sent to the executors carry this module's code, which need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAIN = 1 << 24
# Training rows that one packed row holds.
BLOCK_ROWS = 16_384
# Training rows of one task: sums over them take longer than a task takes to start.
TASK_ROWS = 8 * BLOCK_ROWS
# Tasks whose sums the driver adds by itself; more are added in two steps.
TASKS_PER_MERGE = 16
# Trees after which the rows' margins are written down; until then each tree's are held by the executors.
TREES_PER_WRITE = 25
# Cut points come from values grouped by this relative width.
VALUE_STEPS = 200


@dataclass(frozen=True)
class BoostingSettings:
    """Hyperparameters; the defaults are the published ones, and the usual ones where none are published."""

    rounds: int = 300
    depth: int = 5
    learning_rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    penalty: float = 1.0
    min_gain: float = 0.0
    min_curvature: float = 1.0
    max_bins: int = 256
    seed: int = SEED


@dataclass(frozen=True)
class Tree:
    """A binary tree by node number: the children of ``i`` are ``2 i + 1`` and ``2 i + 2``.

    ``feature`` is -1 where a node is not split; rows with a value up to ``cut`` (a bin up to ``bin``) go left. ``cover`` is
    the curvature of a node's training rows and ``value`` what a row that ends there adds to its margin.
    """

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        nodes = (2 << depth) - 1
        return cls(np.full(nodes, -1), np.zeros(nodes, np.int64), *(np.zeros(nodes) for _ in range(3)))

    def packed(self) -> bytes:
        return np.stack([self.feature, self.bin, self.cut, self.cover, self.value]).astype(float).tobytes()

    @classmethod
    def unpacked(cls, body: bytes) -> Tree:
        feature, at, *rest = np.frombuffer(body).reshape(5, -1)
        return cls(feature.astype(np.int64), at.astype(np.int64), *rest)

    def node_of(self, values: np.ndarray, by_bin: bool, depth: int) -> np.ndarray:
        """The node at which each row of ``values`` (rows x inputs) stands after ``depth`` levels, or where it ended."""
        node = np.zeros(len(values), np.int64)
        bound = self.bin if by_bin else self.cut
        rows = np.arange(len(values))
        for _ in range(depth):
            split = self.feature[node] >= 0
            right = values[rows, np.maximum(self.feature[node], 0)] > bound[node]
            node = np.where(split, 2 * node + 1 + right, node)
        return node


@dataclass(frozen=True)
class BoostedModel:
    inputs: tuple[str, ...]
    settings: BoostingSettings
    trees: list[Tree] = field(default_factory=list)
    #: Margin without any tree.
    base: float = 0.0

    def margins(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.base)
        for tree in self.trees:
            total += tree.value[tree.node_of(values, False, self.settings.depth)]
        return total

    def score(self, df: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
        """The ``keep`` columns of ``df``, which holds the prepared inputs, with ``margin`` and ``score``, the probability."""
        schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("margin", T.DoubleType()), T.StructField("score", T.DoubleType())])

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                margin = self.margins(batch[list(self.inputs)].to_numpy(dtype=float))
                yield batch[list(keep)].assign(margin=margin, score=1 / (1 + np.exp(-margin)))

        return df.select(*dict.fromkeys([*keep, *self.inputs])).mapInPandas(work, schema)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """``tree, node, feature, cut, cover, value`` of all nodes that rows reach; ``feature`` is null at a leaf."""
        rows = [
            (t, i, self.inputs[tree.feature[i]] if tree.feature[i] >= 0 else None, float(tree.cut[i]), float(tree.cover[i]), float(tree.value[i]))
            for t, tree in enumerate(self.trees)
            for i in _reached(tree)
        ]
        return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, cover double, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        """The nodes and, beside them, inputs and settings; both are as small as the settings make them."""
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        head = spark.createDataFrame([(list(self.inputs), self.base)], "inputs array<string>, base double")
        head = head.withColumns({k: F.lit(v) for k, v in asdict(self.settings).items()})
        head.write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        kinds = {"int": "bigint", "float": "double"}
        fields = ", ".join(f"{k} {kinds[v]}" for k, v in BoostingSettings.__annotations__.items())
        head = spark.read.schema(f"inputs array<string>, base double, {fields}").json(f"{path}/settings").first().asDict()
        inputs, base = tuple(head.pop("inputs")), head.pop("base")
        settings = BoostingSettings(**head)
        trees: list[Tree] = []
        for row in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            if row["tree"] == len(trees):
                trees.append(Tree.empty(settings.depth))
            tree, i = trees[-1], row["node"]
            tree.feature[i] = -1 if row["feature"] is None else inputs.index(row["feature"])
            tree.cut[i], tree.cover[i], tree.value[i] = row["cut"], row["cover"], row["value"]
        return cls(inputs, settings, trees, base)

    def importance(self, spark: SparkSession) -> DataFrame:
        """``feature, importance``: the share of each input in the curvature of the rows that its splits part."""
        split = self.nodes(spark).filter("feature IS NOT NULL").groupBy("feature").agg(F.sum("cover").alias("cover"))
        total = split.agg(F.sum("cover")).scalar()
        every = spark.createDataFrame([(c,) for c in self.inputs], "feature string").join(split, "feature", "left")
        share = F.coalesce(F.col("cover") / total, F.lit(0.0))
        return every.select("feature", share.alias("importance")).orderBy(F.desc("importance"), "feature")

    def ensemble(self) -> Ensemble:
        """The trees as ``explain`` takes them: attributions on the margin scale, weighed by curvature."""
        leaves = [leaf for tree in self.trees for leaf in _leaves(tree)]
        found = ensemble_from_leaves(leaves)
        return Ensemble(found.groups, found.base_value + self.base)


def _reached(tree: Tree) -> Iterator[int]:
    pending = [0]
    while pending:
        node = pending.pop(0)
        yield node
        if tree.feature[node] >= 0:
            pending += [2 * node + 1, 2 * node + 2]


def _leaves(tree: Tree) -> Iterator[tuple[dict, float]]:
    pending: list[tuple[int, dict]] = [(0, {})]
    while pending:
        node, path = pending.pop()
        f = int(tree.feature[node])
        if f < 0:
            yield path, float(tree.value[node])
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((2 * node + 1, (low, min(high, tree.cut[node]))), (2 * node + 2, (max(low, tree.cut[node]), high))):
            pending.append((child, path | {f: (*bounds, share * tree.cover[child] / tree.cover[node])}))


def quantile_cuts(df: DataFrame, inputs: Sequence[str], bins: int) -> dict[str, np.ndarray]:
    """Up to ``bins`` - 1 increasing cut points of each input, all of them values of it.

    Values are grouped by a relative width of 1 / VALUE_STEPS, whole numbers below that many stay apart; groups are counted
    in one aggregate for all inputs and a cut stands at the largest value of the group in which a quantile falls. The
    number of groups is bounded by the range of doubles, and counts do not depend on the order of the rows.
    """

    def step(value: Column) -> Column:
        return F.signum(value) * F.floor(F.log1p(F.abs(value) * 1e6) * VALUE_STEPS)

    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("input"), F.col(c).cast("double").alias("value")) for i, c in enumerate(inputs)]))
    found = df.select(cells.alias("cell")).select("cell.*").groupBy("input", step(F.col("value")).alias("step")).agg(F.max("value").alias("value"), F.count("*").alias("n"))
    table = found.orderBy("input", "value").toPandas()
    cuts = {}
    for i, name in enumerate(inputs):
        own = table[table["input"] == i]
        value, after = own["value"].to_numpy(), own["n"].cumsum().to_numpy()
        if len(value) > bins:
            wanted = after[-1] * np.arange(1, bins) / bins
            value = value[np.unique(np.searchsorted(after, wanted))]
        cuts[name] = value[value < own["value"].max()] if len(value) else value
    return cuts


_BLOCK = T.StructType([T.StructField(c, T.BinaryType()) for c in ("bins", "label", "draw", "margin")])


def packed_rows(train: DataFrame, cuts: Mapping[str, np.ndarray], base: float, seed: int, label: str = LABEL) -> DataFrame:
    """Training rows in blocks: bins of the inputs, label, a number by which rows are drawn, and margin."""
    inputs = list(cuts)
    bounds = [np.asarray(cuts[c], float) for c in inputs]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                values = [part.column(j).to_numpy(zero_copy_only=False) for j in range(len(inputs))]
                bins = np.stack([np.searchsorted(b, v) for b, v in zip(bounds, values, strict=True)], axis=1).astype(np.uint8)
                labels = part.column(len(inputs)).to_numpy(zero_copy_only=False).astype(np.uint8)
                draw = part.column(len(inputs) + 1).to_numpy(zero_copy_only=False)
                body = (bins.tobytes(), labels.tobytes(), draw.tobytes(), np.full(len(labels), base).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in body], names=_BLOCK.names)

    rows = train.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(inputs)], F.col(label).cast("int").alias("_label"), F.xxhash64(F.lit(seed), F.col(ID)).alias("_draw"))
    return rows.mapInArrow(work, _BLOCK)


def _unpacked(batches: Iterator[pa.RecordBatch], inputs: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for bins, label, draw, margin in zip(*(batch.column(i) for i in range(4)), strict=True):
            rows = np.frombuffer(label.as_buffer(), np.uint8)
            yield (
                np.frombuffer(bins.as_buffer(), np.uint8).reshape(len(rows), inputs), rows,
                np.frombuffer(draw.as_buffer(), np.uint64), np.frombuffer(margin.as_buffer(), float),
            )


def _drawn(draw: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Which rows a tree learns from, by a hash of their number and the tree's."""
    h = (draw ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(11)).astype(float) < share * 2.0**53


def gradients(margin: np.ndarray, label: np.ndarray, positive_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of each row's weighted logistic loss, in units of 1 / GRAIN."""
    p = 1 / (1 + np.exp(-margin))
    weight = np.where(label == 1, positive_weight, 1.0)
    return np.floor((p - label) * weight * GRAIN + 0.5), np.floor(p * (1 - p) * weight * GRAIN + 0.5)


@dataclass(frozen=True)
class _Request:
    """What to sum for one level of a tree: its nodes so far, the nodes and input columns wanted, and the tree's number."""

    tree: Tree
    number: int
    level: int
    wanted: tuple[int, ...]
    columns: np.ndarray
    positive_weight: float
    settings: BoostingSettings

    @property
    def shape(self) -> tuple[int, int, int]:
        return len(self.wanted), len(self.columns), self.settings.max_bins

    def add(self, total: np.ndarray, bins: np.ndarray, label: np.ndarray, draw: np.ndarray, margin: np.ndarray) -> None:
        """Add the rows of a block to sums of gradient and curvature by (wanted node, input, bin)."""
        slot = np.full((2 << self.settings.depth) - 1, -1)
        slot[list(self.wanted)] = np.arange(len(self.wanted))
        kept = _drawn(draw, self.number, self.settings.row_share)
        bins = bins[kept]
        own = slot[self.tree.node_of(bins, True, self.level)]
        here = own >= 0
        own, bins = own[here], bins[here]
        parts = gradients(margin[kept][here], label[kept][here], self.positive_weight)
        for j, column in enumerate(self.columns):
            place = (own * len(self.columns) + j) * self.settings.max_bins + bins[:, column]
            for table, part in zip(total, parts, strict=True):
                table += np.bincount(place, part, len(table))


def _unpacked_rows(blocks: DataFrame, inputs: int) -> RDD:
    def work(row) -> tuple[np.ndarray, ...]:
        label = np.frombuffer(row["label"], np.uint8)
        return np.frombuffer(row["bins"], np.uint8).reshape(len(label), inputs), label, np.frombuffer(row["draw"], np.uint64), np.frombuffer(row["margin"])

    return blocks.rdd.map(work)


def _after_tree(rows: RDD, tree: Tree, depth: int) -> RDD:
    """The blocks of ``rows`` with what ``tree`` adds to their margins."""

    def work(block: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        bins, label, draw, margin = block
        return bins, label, draw, margin + tree.value[tree.node_of(bins, True, depth)]

    return rows.map(work)


def _distributed_sums(rows: RDD, request: _Request) -> np.ndarray:
    def work(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
        total = np.zeros((2, np.prod(request.shape)))
        for block in blocks:
            request.add(total, *block)
        yield total.astype(np.int64)

    depth = 1 if rows.getNumPartitions() <= TASKS_PER_MERGE else 2
    return rows.mapPartitions(work).treeReduce(np.add, depth).reshape(2, *request.shape)


def best_split(table: np.ndarray, settings: BoostingSettings) -> tuple[float, int, int, int, int] | None:
    """Gain, input, bin and the left child's sums of the best split of one node; ties go to the first input and bin."""
    g, h = np.cumsum(table, axis=2)
    total_g, total_h = int(g[0, -1]), int(h[0, -1])

    def strength(a, b):
        return (a / GRAIN) ** 2 / (b / GRAIN + settings.penalty)

    gain = strength(g, h) + strength(total_g - g, total_h - h) - strength(total_g, total_h)
    least = settings.min_curvature * GRAIN
    gain = np.where((h >= least) & (total_h - h >= least) & (h > 0) & (total_h - h > 0), gain / 2, -np.inf)
    column, at = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
    if not gain[column, at] > max(settings.min_gain, 1e-9):
        return None
    return float(gain[column, at]), int(column), int(at), int(g[column, at]), int(h[column, at])


def _grow(number: int, cuts: list[np.ndarray], positive_weight: float, settings: BoostingSettings, summed: Callable[[_Request], np.ndarray]) -> Tree:
    tree = Tree.empty(settings.depth)
    chosen = np.random.default_rng([settings.seed, number]).permutation(len(cuts))[: max(1, int(settings.column_share * len(cuts)))]
    columns = np.sort(chosen)

    def sums(level: int, wanted: list[int]) -> dict[int, np.ndarray]:
        found = summed(_Request(tree, number, level, tuple(wanted), columns, positive_weight, settings))
        return {node: found[:, i] for i, node in enumerate(wanted)}

    def settle(node: int, g: int, h: int) -> None:
        tree.cover[node] = h / GRAIN
        tree.value[node] = -settings.learning_rate * (g / GRAIN) / (h / GRAIN + settings.penalty)

    tables = sums(0, [0])
    settle(0, *(int(x) for x in tables[0][:, 0].sum(axis=1)))
    for level in range(settings.depth):
        lighter, parents = [], {}
        for node, table in tables.items():
            split = best_split(table, settings)
            if split is None:
                continue
            _, column, at, g, h = split
            tree.feature[node], tree.bin[node] = columns[column], at
            tree.cut[node] = cuts[columns[column]][at]
            total_g, total_h = (int(x) for x in table[:, 0].sum(axis=1))
            settle(2 * node + 1, g, h)
            settle(2 * node + 2, total_g - g, total_h - h)
            small = 2 * node + 1 if 2 * h <= total_h else 2 * node + 2
            lighter.append(small)
            parents[small] = (node, table)
        if not lighter or level == settings.depth - 1:
            break
        found = sums(level + 1, lighter)
        tables = {}
        for small, (node, table) in parents.items():
            tables[small], tables[4 * node + 3 - small] = found[small], table - found[small]
    return tree


def _grow_in_one_task(blocks: DataFrame, cuts: list[np.ndarray], positive_weight: float, settings: BoostingSettings) -> list[Tree]:
    """All trees, where the training rows are those of one task: the same sums, without a job for each level."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [list(block) for block in _unpacked(batches, len(cuts))]

        def summed(request: _Request) -> np.ndarray:
            total = np.zeros((2, np.prod(request.shape)))
            for block in rows:
                request.add(total, *block)
            return total.astype(np.int64).reshape(2, *request.shape)

        for number in range(settings.rounds):
            tree = _grow(number, cuts, positive_weight, settings, summed)
            for block in rows:
                block[3] = block[3] + tree.value[tree.node_of(block[0], True, settings.depth)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([tree.packed()], pa.binary())], names=["number", "tree"])

    found = blocks.mapInArrow(work, "number long, tree binary").toArrow().sort_by("number")
    return [Tree.unpacked(body.as_py()) for body in found["tree"]]


def _with_margins(blocks: DataFrame, recent: list[Tree], depth: int, inputs: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for bins, _, _, margin in _unpacked(iter([batch]), inputs):
                for tree in recent:
                    margin = margin + tree.value[tree.node_of(bins, True, depth)]
                margins.append(margin.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(margins, pa.binary())], names=_BLOCK.names)

    return blocks.mapInArrow(work, _BLOCK)


def fit(train: DataFrame, positive_weight: float, settings: BoostingSettings = BoostingSettings(), inputs: Sequence[str] = INPUTS, cuts: Mapping[str, Sequence[float]] | None = None, label: str = LABEL) -> BoostedModel:
    """Boost trees on ``train``, which holds the id, the label (0 or 1) and the prepared inputs, none of them null.

    ``cuts``: cut points of each input (at most ``max_bins`` - 1); by default quantiles. Without rows, or where one class
    only leaves no gain, trees stay single leaves.
    """
    if settings.max_bins > 256:
        raise ValueError("a bin is stored in one byte: at most 256")
    found = quantile_cuts(train, inputs, settings.max_bins) if cuts is None else {c: np.asarray(cuts[c], float) for c in inputs}
    model = BoostedModel(tuple(inputs), settings)
    bounds = [found[c] for c in inputs]
    tasks = -(-train.count() // TASK_ROWS) or 1

    def stored(rows: DataFrame) -> DataFrame:
        return materialise(rows, "boosting-rows").coalesce(tasks)

    blocks = stored(packed_rows(train.repartition(tasks, ID), found, model.base, settings.seed, label))
    if tasks == 1:
        model.trees.extend(_grow_in_one_task(blocks, bounds, positive_weight, settings))
        return model
    recent: list[Tree] = []
    rows, before = _unpacked_rows(blocks, len(bounds)).persist(StorageLevel.MEMORY_AND_DISK), None
    for number in range(settings.rounds):
        tree = _grow(number, bounds, positive_weight, settings, lambda request: _distributed_sums(rows, request))
        model.trees.append(tree)
        recent.append(tree)
        if before is not None:
            before.unpersist()
        before = rows
        if len(recent) == TREES_PER_WRITE and number + 1 < settings.rounds:
            blocks = stored(_with_margins(blocks, recent, settings.depth, len(bounds)))
            recent = []
            rows = _unpacked_rows(blocks, len(bounds)).persist(StorageLevel.MEMORY_AND_DISK)
        else:
            rows = _after_tree(before, tree, settings.depth).persist(StorageLevel.MEMORY_AND_DISK)
    if before is not None:
        before.unpersist()
    rows.unpersist()
    return model
