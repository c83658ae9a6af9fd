"""Score day-over-day moves of metric series against thresholds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.functions.columns import flag
from revlens.operators.reshape import melt

# Metric, category, threshold, how the change is measured.
METRICS = [
    ("mrr", "revenue", "0.10", "percent_change"),
    ("churn_rate", "retention", "0.02", "absolute_change"),
    ("daily_active_users", "engagement", "50", "absolute_change"),
    ("events_per_active_user", "engagement", "0.20", "percent_change"),
    ("event_failure_rate", "reliability", "0.05", "absolute_change"),
    ("transaction_failure_rate", "reliability", "0.05", "absolute_change"),
    ("completed_transaction_volume", "revenue", "0.25", "percent_change"),
    ("active_subscriptions", "retention", "10", "absolute_change"),
    ("cancelled_subscriptions", "retention", "3", "absolute_change"),
]
# Severity by multiple of the threshold reached.
SEVERITY_STEPS = [("critical", "2"), ("high", "1.5"), ("medium", "1")]
SEVERITIES = ("critical", "high", "medium", "low")

# Comparisons run on exact decimals: in doubles 0.15 - 0.10 is not 0.05. Twelve
# places are what a double holds reliably; with 19 digits before the point,
# value x (threshold x multiple) still fits 38 digits.
EXACT = "decimal(31,12)"
LIMIT = "decimal(6,3)"


def metric_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        METRICS, "metric_name string, metric_category string, threshold string, threshold_type string"
    ).withColumn("threshold", F.col("threshold").cast(LIMIT))


def long_metrics(mart_daily_kpis: DataFrame) -> DataFrame:
    """Nine metrics per day in long form: one pass over the KPIs, not nine."""
    return melt(mart_daily_kpis, ["metric_date"], [m[0] for m in METRICS], EXACT,
                "metric_name", "current_value")


def score_series(series: DataFrame, config: DataFrame) -> DataFrame:
    """Score any long series ``(metric_date, metric_name, current_value)``.

    The window is per metric, so series are scored in parallel; ``config`` has
    one row per metric.
    """
    before = F.lag("current_value").over(Window.partitionBy("metric_name").orderBy("metric_date"))
    # The nine-row config is a fixed table, hence a safe broadcast.
    rows = series.withColumn("previous_value", before).join(F.broadcast(config), "metric_name")
    cur, prev, limit = F.col("current_value"), F.col("previous_value"), F.col("threshold")
    move = F.abs(cur - prev)
    relative = F.col("threshold_type") == "percent_change"
    # Without a base a relative move counts as no move. Both sides are compared
    # multiplied out, so nothing is divided or rounded.
    comparable = ~relative | (prev != 0)
    scale = F.when(relative, F.abs(prev)).otherwise(F.lit(1).cast(EXACT))

    def reaches(multiple: str):
        return comparable & (move >= scale * (limit * F.lit(multiple).cast("decimal(2,1)")).cast(LIMIT))

    severity = F.when(prev.isNull(), "none")
    for name, multiple in SEVERITY_STEPS:
        severity = severity.when(reaches(multiple), name)
    return rows.select(
        "metric_date", "metric_name", "metric_category",
        cur.cast("double").alias("current_value"),
        prev.cast("double").alias("previous_value"),
        (cur - prev).cast("decimal(31,9)").cast("double").alias("absolute_change"),
        F.round(F.try_divide((cur - prev).cast("double"), prev.cast("double")), 9).alias("percent_change"),
        limit.cast("double").alias("threshold_value"),
        severity.otherwise("low").alias("severity"),
        F.when(cur > prev, "up").when(cur < prev, "down").otherwise("flat").alias("anomaly_direction"),
        flag(comparable & (move > scale * limit)).alias("should_investigate"),
    )


def mart_anomaly_candidates(mart_daily_kpis: DataFrame, run_ts: datetime) -> DataFrame:
    scored = score_series(long_metrics(mart_daily_kpis), metric_config(mart_daily_kpis.sparkSession))
    return scored.withColumn("created_at", F.lit(run_ts).cast("timestamp")) \
        .orderBy(F.desc("metric_date"), "metric_category", "metric_name")
