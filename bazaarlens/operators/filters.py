"""Global filters over item rows, and the value lists to choose from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_COLUMNS = ("order_purchase_timestamp", "state", "category", "payment_type")


@dataclass(frozen=True)
class Filters:
    """An empty list does not filter, and neither does a date range without exactly two bounds."""

    date_range: Sequence[date] = ()
    states: Sequence[str] = ()
    categories: Sequence[str] = ()
    payment_types: Sequence[str] = ()


def apply_filters(items: DataFrame, filters: Filters) -> DataFrame:
    """The items within the filters. Where there is a ``month``, it is the month key of the purchase, and the months of the
    date range are chosen as well: items stored by month are then read from these folders alone."""
    if len(filters.date_range) == 2:
        first, last = (F.lit(day) for day in filters.date_range)
        # Compared as timestamps, and not through to_date, so that the bounds reach the Parquet scan.
        purchased = F.col("order_purchase_timestamp")
        items = items.filter(
            (purchased >= first.cast("timestamp_ntz")) & (purchased < F.date_add(last, 1).cast("timestamp_ntz"))
        )
        if "month" in items.columns:
            items = items.filter(F.col("month").between(*(f"{day:%Y-%m}" for day in filters.date_range)))
    for column, chosen in (
        ("state", filters.states),
        ("category", filters.categories),
        ("payment_type", filters.payment_types),
    ):
        if chosen:
            items = items.filter(F.col(column).isin(list(chosen)))
    return items


def date_bounds(items: DataFrame) -> DataFrame:
    """First and last purchase day as one row."""
    purchased = F.col("order_purchase_timestamp")
    return items.agg(
        F.to_date(F.min(purchased)).alias("min_date"), F.to_date(F.max(purchased)).alias("max_date")
    )


def options(items: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values of a filter column."""
    return items.select(F.col(column).alias("value")).dropna().distinct().orderBy("value")


def all_options(items: DataFrame) -> DataFrame:
    """``filter, value`` for the state, category and payment filters, from one pass over the items."""
    cells = [F.struct(F.lit(c).alias("filter"), F.col(c).alias("value")) for c in ("state", "category", "payment_type")]
    return items.select(F.inline(F.array(*cells))).dropna(subset=["value"]).distinct().orderBy("filter", "value")
