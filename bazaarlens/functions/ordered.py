"""Exact order statistics and running totals without sorting a whole dataset into one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.storage import materialise

# A remaining interval with at most this many values is finished by one bounded sort; the result is the same either way.
FINISH_SIZE = 10_000
# percentile_approx with this accuracy is off by at most 1/ACCURACY of the rank range.
ACCURACY = 10_000
PIVOT_SPREAD = 3.0 / ACCURACY
# Keys of one range of running totals.
KEYS_PER_RANGE = 50_000
# Children of a node in the tree over these ranges.
RANGES_PER_NODE = 1_000


@dataclass
class _Search:
    name: str
    value: Column
    rank: int
    low: float | None
    high: float | None
    below: int
    inside: int
    answer: float | None = None

    def values(self) -> Column:
        """The values still in play: strictly between the excluded bounds."""
        keep = self.value.isNotNull()
        if self.low is not None:
            keep = keep & (self.value > F.lit(self.low))
        if self.high is not None:
            keep = keep & (self.value < F.lit(self.high))
        return F.when(keep, self.value)

    def fractions(self) -> list[float]:
        centre = (self.rank - self.below + 0.5) / self.inside
        return [min(max(centre + shift, 0.0), 1.0) for shift in (-PIVOT_SPREAD, 0.0, PIVOT_SPREAD)]


def order_statistics(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Callable[[str, int], Sequence[int]],
) -> dict[str, list[float]]:
    """Exact values at the given zero-based ranks of each named column, nulls left out.

    Each round takes approximate percentiles around every wanted rank as pivots, counts how many values lie
    below and at each pivot, and narrows to the interval that holds the rank. A round is two plain aggregates for
    all columns together, so no shuffle grows with the data; the interval shrinks about a thousandfold per round,
    and equal values end the search at once because they are counted, not sorted.
    """
    counts = df.agg(*[F.count(v).alias(n) for n, v in values.items()]).first()
    searches = [
        _Search(name, value.cast("double"), rank, None, None, 0, counts[name])
        for name, value in values.items()
        for rank in (ranks(name, counts[name]) if counts[name] else ())
    ]
    open_searches = list(searches)
    while open_searches:
        large = [s for s in open_searches if s.inside > FINISH_SIZE]
        small = [s for s in open_searches if s.inside <= FINISH_SIZE]
        if small:
            finished = df.agg(
                *[
                    F.element_at(F.sort_array(F.collect_list(s.values())), s.rank - s.below + 1).alias(f"v{i}")
                    for i, s in enumerate(small)
                ]
            ).first()
            for i, search in enumerate(small):
                search.answer = finished[f"v{i}"]
        if large:
            _narrow(df, large)
        open_searches = [s for s in large if s.answer is None]
    return {name: [s.answer for s in searches if s.name == name] for name in values}


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    pivots = df.agg(
        *[
            F.percentile_approx(s.values(), s.fractions(), ACCURACY).alias(f"p{i}")
            for i, s in enumerate(searches)
        ]
    ).first()
    points = [sorted(set(pivots[f"p{i}"])) for i in range(len(searches))]
    row = df.agg(
        *[
            F.count_if(condition).alias(f"{label}{i}_{j}")
            for i, s in enumerate(searches)
            for j, point in enumerate(points[i])
            for label, condition in (("lt", s.values() < F.lit(point)), ("eq", s.values() == F.lit(point)))
        ]
    ).first()
    for i, search in enumerate(searches):
        start, size = search.below, search.inside
        for j, point in enumerate(points[i]):
            first = start + row[f"lt{i}_{j}"]
            after = first + row[f"eq{i}_{j}"]
            if search.rank < first:
                search.high, search.inside = point, first - search.below
                break
            if search.rank < after:
                search.answer = point
                break
            search.low, search.below = point, after
            search.inside = start + size - after


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median per column: the mean of the two middle values, nulls left out."""
    found = order_statistics(df, {c: F.col(c) for c in columns}, lambda _, n: sorted({(n - 1) // 2, n // 2}))
    return {c: sum(v) / len(v) if v else None for c, v in found.items()}


def _offsets(totals: DataFrame, sums: Sequence[str], ranges: int) -> DataFrame:
    """``range`` with ``before_<name>``: totals of ``sums`` over all ranges above each one, of ``ranges`` in all.

    Ranges are leaves of a tree with RANGES_PER_NODE children a node: a range's offset is its node's, from the level above,
    and the totals of its later siblings, so no window holds more than RANGES_PER_NODE rows.
    """
    node = F.floor(F.col("range") / F.lit(RANGES_PER_NODE)).cast("int")
    later = Window.partitionBy("node").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    marked = totals.withColumn("node", node)
    own = marked.select("range", "node", *[F.coalesce(F.sum(s).over(later), F.lit(0)).alias(f"before_{s}") for s in sums])
    if ranges <= RANGES_PER_NODE:
        return own.drop("node")
    above = marked.groupBy("node").agg(*[F.sum(s).alias(s) for s in sums]).withColumnRenamed("node", "range")
    above = _offsets(above, sums, -(-ranges // RANGES_PER_NODE))
    above = above.select(F.col("range").alias("node"), *[F.col(f"before_{s}").alias(f"above_{s}") for s in sums])
    joined = own.join(above, "node")
    return joined.select("range", *[(F.col(f"before_{s}") + F.col(f"above_{s}")).alias(f"before_{s}") for s in sums])


def running_totals(df: DataFrame, key: str, sums: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Add ``cum_<name>`` columns: totals of ``sums`` over all rows with a key greater than or equal to this one.

    ``df`` holds one row per key (null keys drop out). Rows are dealt into ``buckets`` ranges of keys, by default as many as
    the keys need, and stored with the number of their range, so that a task that is run again finds the same ranges.
    Windows run inside a range, and a tree over the ranges carries the offsets.
    """
    buckets = buckets or -(-df.count() // KEYS_PER_RANGE) or 1
    dealt = df.filter(F.col(key).isNotNull()).repartitionByRange(buckets, key).withColumn("_range", F.spark_partition_id())
    ranged = materialise(dealt, "key-ranges")
    totals = ranged.groupBy(F.col("_range").alias("range")).agg(*[F.sum(s).alias(s) for s in sums])
    offsets = _offsets(totals, sums, buckets).withColumnRenamed("range", "_range")
    within = Window.partitionBy("_range").orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(offsets, "_range")
        .withColumns({f"cum_{s}": F.sum(s).over(within) + F.col(f"before_{s}") for s in sums})
        .drop("_range", *[f"before_{s}" for s in sums])
    )
