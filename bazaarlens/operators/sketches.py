"""Distinct counts from stored sketches: the approximate form for dashboards that ask for ever new ranges of days.

The exact counts of :mod:`sales` and :mod:`regional` stay the default. A sketch of each day and key is made once, in one
aggregate with partial sums, and has at most some 2^lg_k bytes; counts over any range of days, months or keys are unions of
stored sketches and do not read the items again. An estimate depends a little on the order in which sketches were united,
within the error that :func:`allowed_error` states.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "order_day"
LG_K = 12


def _sketch(value: str) -> str:
    return f"{value}_sketch"


def day_sketches(
    items: DataFrame, values: Sequence[str], keys: Sequence[str] = (), time_col: str = "order_purchase_timestamp", lg_k: int = LG_K
) -> DataFrame:
    """``order_day``, the keys, and a sketch of the distinct non-null texts of each value.

    Rows without a time have the day null; a null key is a key of its own.
    """
    day = F.col(time_col).cast("date").alias(DAY)
    return items.groupBy(day, *keys).agg(*[F.hll_sketch_agg(F.col(v).cast("string"), lg_k).alias(_sketch(v)) for v in values])


def merged(sketches: DataFrame, values: Sequence[str], by: Sequence[str | Column] = ()) -> DataFrame:
    """Sketches of coarser groups, to be stored in turn or counted."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(_sketch(v)).alias(_sketch(v)) for v in values])


def distinct_counts(
    sketches: DataFrame, values: Sequence[str], by: Sequence[str | Column] = (), first: date | None = None, last: date | None = None
) -> DataFrame:
    """About how many distinct values each group has in the days from ``first`` to ``last``, both included.

    Without bounds undated rows count, too; with one of them they do not. Without groups a range without rows has no count.
    """
    if first is not None:
        sketches = sketches.filter(F.col(DAY) >= F.lit(first))
    if last is not None:
        sketches = sketches.filter(F.col(DAY) <= F.lit(last))
    groups = merged(sketches, values, by)
    kept = [c for c in groups.columns if c not in {_sketch(v) for v in values}]
    return groups.select(*kept, *[F.hll_sketch_estimate(_sketch(v)).alias(v) for v in values])


def allowed_error(exact: Column, lg_k: int = LG_K, deviations: float = 4.0) -> Column:
    """What a count from merged sketches may be off: so many standard errors of 1.04 / sqrt(2^lg_k), and one at least."""
    return F.greatest(F.lit(1.0), exact * (deviations * 1.04 / math.sqrt(1 << lg_k)))


def compared(exact: DataFrame, approximate: DataFrame, key: str, values: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """The exact counts, and for each value whether the approximate one is within the allowed error. Null keys meet."""
    about = approximate.select(F.col(key).alias("__key"), *[F.col(v).alias(f"__{v}") for v in values])
    both = exact.join(about, exact[key].eqNullSafe(about["__key"]), "left")
    within = [
        F.coalesce(F.abs(F.col(f"__{v}") - F.col(v)) <= allowed_error(F.col(v), lg_k), F.lit(False)).alias(f"{v}_within") for v in values
    ]
    return both.select(key, *values, *within)
