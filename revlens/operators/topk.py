from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int,
                name: str = "record_no") -> DataFrame:
    """First ``limit`` rows of each group, numbered.

    The literal bound lets Spark drop all but ``limit`` rows per group and map
    task before the exchange (WindowGroupLimit).
    """
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rn).where(F.col(name) <= limit)


def first_rows(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Global top-k: TakeOrderedAndProject, at most ``limit`` rows per task travel."""
    return df.orderBy(*order).limit(limit)


def records_json(df: DataFrame, order: Sequence[Column], limit: int = 25) -> DataFrame:
    """The first rows as JSON records, dates in ISO form."""
    top = first_rows(df, order, limit)
    return top.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
