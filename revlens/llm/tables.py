"""Tables in the shared folder, and row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import shared_dir

# With it Spark deletes a query's shuffle files when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# What the contracts call a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, records: int | None = None) -> DataFrame:
    """``df`` written to a fresh table of the shared folder and read again.

    It cuts the lineage: a lost executor costs the running tasks, not the plan
    below the table, and what was numbered or drawn at random stays as it is. Shuffle
    files that the table came from are not needed any more and go at once. ``records``
    is how many rows Python gets at once, where a row holds whole texts.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    conf = {_CLEAN: "true"} | ({_RECORDS: str(records)} if records else {})
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], size: str | None = None) -> DataFrame:
    """``df`` with ``row`` (from 0, in the given order) and, for a ``size`` column, ``end``: its running sum.

    Rows are dealt out by range and sorted where they are, so equal keys spread over
    tasks by the later order columns. Only one row per partition is summed globally.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    amount = F.col(size) if size else F.lit(0).cast("long")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum(amount).alias("_sum"))
             .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
                     F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum")))
    joined = placed.join(parts, "_part")
    row = F.col("_rows") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = [*df.columns, row.alias("row")]
    if size:
        within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out.append((F.col("_sum") + F.sum(amount).over(within)).alias("end"))
    return joined.select(*out)


def salted(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``df`` with ``salt``: 0, but from 1 on another one for every ``most`` rows of the keys with more rows.

    Rows with equal keys must be equal: which of them gets which salt is drawn, how many
    get it follows from the data. The draw spreads a key's rows over tasks.
    """
    often = stored(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
                   .select(*(F.col(k).alias(f"_{k}") for k in keys)))
    zero = F.lit(0).cast("long")
    if often.isEmpty():
        return df.withColumn("salt", zero)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    many = df.join(often, same, "left_semi").withColumn("_any", F.rand(0))
    lined = numbered(many, [*(F.col(k) for k in keys), F.col("_any")])
    lined = lined.withColumn("salt", F.floor(F.col("row") / most).cast("long") + 1).drop("_any", "row")
    return df.join(often, same, "left_anti").withColumn("salt", zero).unionByName(lined)
