from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def open_intervals(points: DataFrame, intervals: DataFrame, entity: str, group: str, day: str,
                   first: str, gone: str, count: str = "n_open") -> DataFrame:
    """Points of an entity once for each group with open intervals that day, and their number.

    An interval is open from its day ``first`` up to the day before ``gone`` (NULL: for ever).
    Instead of pairing points with intervals, an interval is a change of +1 and one of -1;
    changes and points run in order of days, and a running sum per entity and group carries
    the count. Rows are points x groups of the entity plus changes, whatever number of
    intervals is open, and one shuffle by entity serves all of it.
    """
    change = F.array(F.struct(F.col(first).alias(day), F.lit(1).alias("_change")),
                     F.struct(F.col(gone).alias(day), F.lit(-1).alias("_change")))
    changes = (
        intervals.select(entity, F.struct(group).alias("_group"), F.explode(change).alias("_c"))
        .select(entity, "_group", "_c.*").where(F.col(day).isNotNull())
        .groupBy(entity, "_group", day).agg(F.sum("_change").alias("_change"))
    )
    lines = points.withColumn("_point", F.lit(True)).unionByName(changes, allowMissingColumns=True)
    groups = F.collect_set("_group").over(Window.partitionBy(entity))
    own = F.when(F.col("_point"), groups).otherwise(F.array("_group"))
    # The default frame goes by day: a change counts on its own day whatever the order of rows.
    so_far = Window.partitionBy(entity, "_group").orderBy(day)
    swept = (lines.where(F.col(entity).isNotNull()).withColumn("_own", own).withColumn("_group", F.explode("_own"))
             .withColumn(count, F.sum("_change").over(so_far)))
    return swept.where(F.col("_point") & (F.col(count) > 0)).select(*points.columns, f"_group.{group}", count)
