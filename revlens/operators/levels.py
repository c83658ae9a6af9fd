from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.calendar import each_day


def daily_levels(changes: DataFrame, key: str, day: str, levels: Sequence[str],
                 flows: Sequence[str], last_day: Column) -> DataFrame:
    """Daily state of a population from its change records.

    ``levels`` are signed changes whose running total is the state (members,
    value), ``flows`` happen on one day only. Work is one map-side-combined
    aggregation of the change records to (key, day) plus a running sum over at
    most one row per calendar day and key; members are never expanded to days.
    """
    daily = changes.groupBy(key, day).agg(*[F.sum(c).alias(c) for c in [*levels, *flows]])
    by_day = Window.partitionBy(key).orderBy(day)
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = daily.select(
        key, F.col(day).alias("_from"), *flows,
        *[F.sum(c).over(so_far).alias(c) for c in levels],
        F.coalesce(F.date_sub(F.lead(day).over(by_day), 1), last_day).alias("_until"),
    )
    dense = each_day(state, F.col("_from"), F.col("_until"), day)
    return dense.select(
        day, key, *levels,
        *[F.when(F.col(day) == F.col("_from"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in flows],
    )
