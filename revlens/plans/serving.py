"""KPI views a dashboard reads. Filters stay predicates, so they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import display_name, fixed, grouped, percent, signed
from revlens.operators.reshape import melt
from revlens.operators.topk import first_rows
from revlens.plans.core import PLANS

# The KPI cards (field, label).
KPI_CARDS = [
    ("mrr", "MRR"),
    ("active_subscriptions", "Active Subscriptions"),
    ("daily_active_users", "Daily Active Users"),
    ("churn_rate", "Churn Rate"),
    ("completed_transaction_volume", "Txn Volume"),
    ("overall_health_score", "Health Score"),
]
# Columns of the anomaly table, and of the daily chart series.
ANOMALY_COLUMNS = ("metric_date", "metric_name", "metric_category", "current_value", "previous_value",
                   "absolute_change", "percent_change", "severity", "anomaly_direction",
                   "should_investigate")
SERIES = {
    "series_mrr": ("mrr", "active_subscriptions"),
    "series_engagement": ("total_product_events", "daily_active_users"),
    "series_churn_reliability": ("churn_rate", "transaction_failure_rate"),
    "series_tx_volume": ("completed_transactions", "failed_transactions", "completed_transaction_volume"),
    "series_tx_failure": ("transaction_failure_rate", "total_transactions"),
}


def date_filter(df: DataFrame, start: date | None, end: date | None, days: int = 90) -> DataFrame:
    """Rows of a date range; without one, the last ``days`` days of the table."""
    if end is None or start is None:
        latest = df.agg(F.max("metric_date").alias("d")).scalar()
        upper = F.lit(end) if end is not None else latest
        lower = F.lit(start) if start is not None else F.date_sub(upper, days)
        return df.where((F.col("metric_date") >= lower) & (F.col("metric_date") <= upper))
    return df.where(F.col("metric_date").between(F.lit(start), F.lit(end)))


def dashboard_filter(mart_anomaly_candidates: DataFrame, start: date | None = None, end: date | None = None,
                     categories: Sequence[str] = (), flags_only: bool = False) -> DataFrame:
    rows = date_filter(mart_anomaly_candidates, start, end)
    if categories:
        rows = rows.where(F.col("metric_category").isin(list(categories)))
    return rows.where("should_investigate") if flags_only else rows


def anomaly_table(mart_anomaly_candidates: DataFrame) -> DataFrame:
    """Display columns, newest first; a missing percentage shows as a dash."""
    shown = F.coalesce(percent(F.col("percent_change")), F.lit("—"))
    return mart_anomaly_candidates.select(
        *[shown.alias(c) if c == "percent_change" else F.col(c) for c in ANOMALY_COLUMNS]
    ).orderBy(F.desc("metric_date"), "metric_name")


def series(mart_daily_kpis: DataFrame, name: str) -> DataFrame:
    return mart_daily_kpis.select("metric_date", *SERIES[name]).orderBy("metric_date")


def series_mrr_by_plan(mart_mrr: DataFrame) -> DataFrame:
    """Plan MRR in long form for a stacked chart."""
    long = melt(mart_mrr, ["metric_date"], [f"{p}_mrr" for p in PLANS], "decimal(28,2)", "plan", "plan_mrr")
    return long.withColumn("plan", display_name(F.replace(F.col("plan"), F.lit("_mrr"))))


def latest_and_previous(df: DataFrame) -> DataFrame:
    """The last two days of a daily series as one row of (latest, previous) structs."""
    last_two = first_rows(df, [F.desc("metric_date")], 2)
    newest = F.struct(*df.columns)
    pair = last_two.agg(F.max(newest).alias("latest"), F.min(newest).alias("previous"))
    return pair.where("latest is not null").withColumn(
        "previous", F.when(F.col("previous.metric_date") < F.col("latest.metric_date"), F.col("previous")))


def _shown(field: str, value: Column) -> Column:
    if field == "churn_rate":
        return percent(value, 2)
    if field == "overall_health_score":
        return fixed(value, 1)
    if field in ("mrr", "completed_transaction_volume"):
        return F.concat(F.lit("$"), grouped(value))
    return grouped(value)


def _shown_change(field: str, value: Column) -> Column:
    if field == "churn_rate":
        return signed(percent(value, 2))
    if field == "overall_health_score":
        return signed(fixed(value, 1))
    if field in ("mrr", "completed_transaction_volume"):
        return F.concat(F.lit("$"), signed(grouped(value)))
    return signed(grouped(value))


def kpi_cards(mart_daily_kpis: DataFrame) -> DataFrame:
    """Six cards: latest value, previous value, change, and how they are shown."""
    fields = [f for f, _ in KPI_CARDS]
    pair = latest_and_previous(mart_daily_kpis.select("metric_date", *fields))

    def card(position: int, field: str, label: str) -> Column:
        now, before = F.col(f"latest.{field}"), F.col(f"previous.{field}")
        return F.struct(
            F.lit(position).alias("position"), F.lit(field).alias("field"), F.lit(label).alias("label"),
            now.cast("double").alias("current_value"), before.cast("double").alias("previous_value"),
            (now - before).cast("double").alias("change"),
            _shown(field, now).alias("display_value"),
            _shown_change(field, now - before).alias("display_change"))

    cards = F.array(*[card(i, f, label) for i, (f, label) in enumerate(KPI_CARDS, 1)])
    return pair.select(F.col("latest.metric_date").alias("metric_date"), F.inline(cards))
