"""Column expressions used in more than one operator. All of them stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 24 * 60 * 60 * 1_000_000


def month_key(timestamp: Column) -> Column:
    """``yyyy-MM`` of a timestamp; null stays null."""
    return F.date_format(timestamp, "yyyy-MM")


def floor_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods from ``start`` to ``end``, rounded toward minus infinity.

    ``datediff`` counts calendar days and ``timestampdiff(DAY)`` truncates toward zero, so neither fits.
    """
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(micros / F.lit(MICROS_PER_DAY))


def half_even(value: Column, digits: int) -> Column:
    """Round a double half-to-even at ``digits`` by scaling, as array libraries do."""
    scale = float(10**digits)
    return F.rint(value.cast("double") * scale) / scale


def as_double(value: Column) -> Column:
    return value.cast("double")


def mean_of(total: Column, count: Column) -> Column:
    """``total / count`` in double precision; null when there is nothing to average."""
    return F.try_divide(total.cast("double"), count.cast("double"))


#: Decimals that a mean of whole numbers keeps where it is averaged again.
MEAN_DIGITS = 8


def exact_mean(total: Column, count: Column) -> Column:
    """``total / count`` of whole numbers (none negative) as a decimal, half up at ``MEAN_DIGITS``; null without a count.

    Sums of such means are whole-number sums: unlike those of doubles they do not depend on the order of the rows.
    """
    doubled = F.lit(2) * count.cast("bigint")
    scaled = F.call_function("div", F.lit(2 * 10**MEAN_DIGITS) * total.cast("bigint") + count, doubled)
    unit = F.lit(1).cast("decimal(1,0)") / F.lit(10**MEAN_DIGITS).cast("decimal(10,0)")
    return F.when(count > 0, (scaled.cast("decimal(18,0)") * unit).cast(f"decimal(18,{MEAN_DIGITS})"))


def not_below(value: Column, bound: float) -> Column:
    """Clip from below but keep null (``greatest`` alone would replace a null by the bound)."""
    return F.when(value < bound, F.lit(bound)).otherwise(value)


def flag(condition: Column) -> Column:
    """1.0 / 0.0 of a condition, with unknown counted as 0.0."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def number_text(value: Column, pattern: str, digits: int) -> Column:
    """``value`` rounded half-to-even and formatted; null stays null (``format_string`` alone prints it)."""
    return F.when(value.isNotNull(), F.format_string(pattern, half_even(value, digits)))


def display_number(value: Column, currency: bool = False) -> Column:
    """Short text of a number for a headline: ``1.23M``, ``4.5k``, else two decimals (currency) or none."""
    value = value.cast("double")
    sign = "R$ " if currency else ""
    return (
        F.when(value >= 1_000_000, number_text(value / 1_000_000, f"{sign}%.2fM", 2))
        .when(value >= 1_000, number_text(value / 1_000, f"{sign}%.1fk", 1))
        .otherwise(number_text(value, f"{sign}%.2f", 2) if currency else number_text(value, "%,.0f", 0))
    )


def seeded_order(key: Column, seed: int) -> Column:
    """A pseudo-random but repeatable sort key, independent of partitioning and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
