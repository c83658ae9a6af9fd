"""Distinct users over ranges of days from one sketch a day, as an opt-in beside the exact counts.

A day's HyperLogLog sketch has a few kilobytes whatever its number of users, so a week, a month
or any range is a union of stored rows; user days are not read again. The relative standard error
is about 1.04 / sqrt(2^PRECISION), 0.8 % as set, and small sets are counted almost exactly.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.calendar import each_day

PRECISION = 14
ERROR = 1.04 / 2 ** (PRECISION / 2)  # relative standard error


def daily_user_sketches(user_day_usage: DataFrame) -> DataFrame:
    """Day, and the sketch of the users with events on it."""
    return (user_day_usage.where("user_id is not null and metric_date is not null").groupBy("metric_date")
            .agg(F.hll_sketch_agg("user_id", PRECISION).alias("users")))


def users_between(sketches: DataFrame, start: date, end: date) -> DataFrame:
    """One row: the estimated number of distinct users of a range of days."""
    inside = sketches.where(F.col("metric_date").between(F.lit(start), F.lit(end)))
    merged = inside.agg(F.hll_union_agg("users").alias("users"))
    return merged.select(F.coalesce(F.hll_sketch_estimate("users"), F.lit(0).cast("long")).alias("distinct_users"))


def rolling_users(sketches: DataFrame, days: int) -> DataFrame:
    """For each day with users, the estimated number of distinct users of the ``days`` days up to it.

    A day's sketch goes to the windows that it lies in; sketches, not users, are shuffled.
    """
    ends = sketches.select(F.col("metric_date").alias("day"))
    spread = each_day(sketches, F.col("metric_date"), F.date_add("metric_date", days - 1), "day")
    return (spread.join(ends, "day", "left_semi").groupBy(F.col("day").alias("metric_date"))
            .agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("distinct_users")))
