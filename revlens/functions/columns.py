"""Column expressions shared by the models. All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """A boolean that is never NULL: an unknown condition is false."""
    return F.coalesce(condition, F.lit(False))


def one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def zero(value: str | Column) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def sum_where(condition: Column, value: Column) -> Column:
    """Sum over matching rows, NULL when none match."""
    return F.sum(F.when(condition, value))


def distinct_where(condition: Column, value: Column) -> Column:
    return F.count_distinct(F.when(condition, value))


def rank_in(value: Column, ordered: Sequence[str]) -> Column:
    """1-based position of a value in an ordered vocabulary, NULL when unknown."""
    position = F.array_position(F.array(*[F.lit(v) for v in ordered]), value)
    return F.nullif(position, F.lit(0)).cast("int")


def display_name(value: Column) -> Column:
    """Snake case to title case; every non-alphanumeric character starts a word."""
    spaced = F.replace(value, F.lit("_"), F.lit(" "))
    pieces = F.split(F.regexp_replace(spaced, r"([^\p{L}\p{N}])", "$1\u0001"), "\u0001")
    return F.array_join(F.transform(pieces, F.initcap), "")


def week_of(day: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", day).cast("date")


def month_of(day: Column) -> Column:
    return F.date_trunc("month", day).cast("date")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def fixed(value: Column, places: int) -> Column:
    """Text of a number with a fixed count of decimals, rounded half up.

    Going through a decimal keeps ties independent of binary representation.
    """
    exact = value.cast("decimal(38,12)")
    return F.round(exact, places).cast(f"decimal(38,{places})").cast("string")


def signed(text: Column) -> Column:
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def percent(value: Column, places: int = 1) -> Column:
    return F.concat(fixed(value.cast("decimal(38,14)") * 100, places), F.lit("%"))


def grouped(value: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(F.round(value.cast("decimal(38,12)"), 0).cast("bigint"), 0)
