from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_with_carry(df: DataFrame, values: Sequence[str], order: Sequence[str], bucket: Column,
                   series: Sequence[str] = (), prefix: str = "previous_") -> DataFrame:
    """The values of each row's predecessor in a series, for series too long for one task.

    ``bucket`` rises with the order (a day, a month of the ordering time, say) and cuts a
    series into ranges. Predecessors are found inside a range; a range's first row gets the last
    row of the range before, which is looked up among one row per range. Only these are in
    order in one task. ``order`` must be unique within a series; NULLs come first.
    """
    keys = [F.col(c) for c in series]
    cut = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    own = F.struct(*values)
    ranged = cut.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_before", F.lag(own).over(inside))
    lasts = cut.groupBy(*keys, "_bucket").agg(F.max_by(own, F.struct(*order)).alias("_last"))
    # One row per range.
    ranges = lasts.select(*keys, F.col("_bucket").alias("_at"), F.lag("_last").over(
        Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    same = F.col("_bucket").eqNullSafe(F.col("_at"))
    for c in series:
        ranges = ranges.withColumnRenamed(c, f"_at_{c}")
        same &= F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    before = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))
    joined = ranged.join(ranges, same, "left").withColumn("_before", before)
    return joined.select(*df.columns, *[F.col(f"_before.{v}").alias(f"{prefix}{v}") for v in values])
