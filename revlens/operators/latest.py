from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Keep the first row of every key under ``order``.

    ``row_number() = 1`` plans a partial WindowGroupLimit before the exchange,
    so a key with very many versions ships one row per map task, not all rows.
    """
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")
