from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str | Column], measures: Sequence[str], type_: str = "double",
         name: str = "measure", value: str = "value") -> DataFrame:
    """Wide to long in one pass over the input."""
    typed = df.select(*ids, *[F.col(m).cast(type_).alias(m) for m in measures])
    id_names = typed.columns[: len(ids)]
    return typed.unpivot(id_names, list(measures), name, value)


def stack_days(day: str, *frames: DataFrame) -> DataFrame:
    """Merge daily series side by side without joins.

    The series are stacked and grouped by day; each column comes from one frame
    that has at most one row per day, so ``max`` just picks it up.
    """
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    values = [c for c in stacked.columns if c != day]
    return stacked.groupBy(day).agg(*[F.max(c).alias(c) for c in values])
