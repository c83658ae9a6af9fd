"""Calendar operators: expand validity to days, fill gaps, span of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def each_day(df: DataFrame, first: Column, last: Column, name: str = "metric_date") -> DataFrame:
    """One row per day of ``[first, last]``; none when the range is empty.

    This is the interval join against a date spine done as a narrow explode.
    The CASE keeps ``sequence`` away from descending bounds, which it rejects.
    """
    days = F.when(first <= last, F.sequence(first, last))
    return df.withColumn(name, F.explode(days))


def day_bounds(df: DataFrame, day: str) -> DataFrame:
    """One row: the first and the last day of a date column."""
    return df.agg(F.min(day).alias("first"), F.max(day).alias("last"))


def all_bounds(*bounds: DataFrame) -> DataFrame:
    """One row: the hull of several one-row bounds; empty sources are ignored."""
    stacked = bounds[0]
    for one in bounds[1:]:
        stacked = stacked.unionByName(one)
    return stacked.agg(F.min("first").alias("first"), F.max("last").alias("last"))


def on_every_day(df: DataFrame, bounds: DataFrame, name: str = "metric_date") -> DataFrame:
    """Every row on every day of the bounds: a calendar without a cross join.

    The list of days is one scalar subquery, evaluated once and exploded
    narrowly.
    """
    days = bounds.select(F.sequence("first", "last")).scalar()
    return df.select(F.explode(days).alias(name), *df.columns)


def fill_days(df: DataFrame, day: str = "metric_date", keep: Sequence[str] = ()) -> DataFrame:
    """Add the missing days between the first and the last row of a daily series.

    Input has one row per day, so the global window sees one row per calendar
    day however large the tables below it are. Every row is stretched to the day
    before its successor; added days carry NULL except in ``keep`` columns,
    which hold their last value.
    """
    following = F.lead(day).over(Window.orderBy(day))
    until = F.coalesce(F.date_sub(following, 1), F.col(day))
    stretched = each_day(df.where(F.col(day).isNotNull()).withColumn("_until", until),
                         F.col(day), F.col("_until"), "_day")
    columns = [
        F.col("_day").alias(day) if c == day
        else F.col(c) if c in keep
        else F.when(F.col("_day") == F.col(day), F.col(c)).alias(c)
        for c in df.columns
    ]
    return stretched.select(*columns)
