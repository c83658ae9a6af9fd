"""Allocate sequential ids to a batch without a global sort.

Rows are spread over hash buckets of their (unique) key. A row's number is its
position inside its bucket plus the sizes of all earlier buckets, so the only
ordered windows are within one bucket and over the bucket sizes. The result
depends on the data alone: recomputing a lost task gives the same ids. Rows
without a key or a day cannot be numbered so, and are an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3  # hex digits of the key's md5: 4096 buckets; more for more tasks


def _numbered(df: DataFrame, key: str, within: Sequence[str], start: Column, digits: int) -> DataFrame:
    missing = F.col(key).isNull()
    for column in within:
        missing = missing | F.col(column).isNull()
    bucket = F.substring(F.md5(F.col(key).cast("string")), 1, digits)
    refuse = F.raise_error(F.lit(f"a row without {' or '.join([key, *within])} cannot get an id"))
    rows = df.withColumn("_bucket", F.when(missing, refuse.cast("string")).otherwise(bucket))
    groups = [*within, "_bucket"]
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    position = F.row_number().over(Window.partitionBy(*groups).orderBy(key))
    # Null-safe, else the join would drop rows without a day before they are refused.
    offsets = offsets.withColumnsRenamed({g: f"_of_{i}" for i, g in enumerate(groups)})
    same = [F.col(g).eqNullSafe(F.col(f"_of_{i}")) for i, g in enumerate(groups)]
    return (
        rows.withColumn("_pos", position)
        .join(offsets, same)
        .withColumn("_n", F.col("_offset") + F.col("_pos") + start)
        .select(*df.columns, "_n")
    )


def highest_number(existing: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the largest trailing number among ids with this prefix, 0 if none."""
    digits = F.regexp_extract(F.col(column), r"(\d+)$", 1)
    number = F.when(F.col(column).startswith(prefix) & (digits != ""), digits.cast("bigint"))
    return existing.agg(F.coalesce(F.max(number), F.lit(0)).alias("highest"))


def _padded(number: Column, width: int) -> Column:
    """Zero-padded text; numbers wider than ``width`` keep all their digits."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def assign_entity_ids(new_rows: DataFrame, key: str, existing: DataFrame, column: str,
                      prefix: str, width: int = 6, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Give new rows ``prefix`` + number, continuing after the existing ids."""
    start = highest_number(existing, column, prefix).scalar()
    numbered = _numbered(new_rows, key, [], start, digits)
    return numbered.withColumn(column, F.concat(F.lit(prefix), _padded(F.col("_n"), width))).drop("_n")


def assign_daily_ids(rows: DataFrame, key: str, day: str, column: str, prefix: str,
                     width: int = 6, digits: int = BUCKET_DIGITS) -> DataFrame:
    """``prefix`` + yyyymmdd + ``_`` + number, numbering restarts every day."""
    numbered = _numbered(rows, key, [day], F.lit(0), digits)
    label = F.concat(F.lit(prefix), F.date_format(day, "yyyyMMdd"), F.lit("_"), _padded(F.col("_n"), width))
    return numbered.withColumn(column, label).drop("_n")
