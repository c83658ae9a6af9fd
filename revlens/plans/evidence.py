"""Investigation: pick flagged moves, gather evidence for all of them, write reports.

Evidence comes in long form, one row per measure of each evidence record:
``(metric_date, section, record_no, evidence_date, record_key, measure, value)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.exact import exact_avg
from revlens.functions.columns import display_name, fixed, percent, signed
from revlens.operators.reshape import melt
from revlens.operators.topk import first_rows, rank_within
from revlens.plans.anomaly import SEVERITIES

TREND_DAYS = 7      # a trend covers the day and the seven before it
MAX_RECORDS = 25    # records per evidence list


# --- flagged moves ----------------------------------------------------------

def classify_anomaly(category: Column, metric: Column) -> Column:
    """Which kind of investigation a move needs; revenue when unknown."""
    return (
        F.when((category == "reliability") & (metric == "event_failure_rate"), "engagement")
        .when(category == "reliability", "transaction")
        .when(category == "retention", "churn")
        .when(category == "engagement", "engagement")
        .otherwise("revenue")
    )


def flagged_anomalies(mart_anomaly_candidates: DataFrame) -> DataFrame:
    kind = classify_anomaly(F.col("metric_category"), F.col("metric_name"))
    return mart_anomaly_candidates.where("should_investigate").withColumn("investigation_type", kind)


def severity_order() -> Column:
    """critical 1 ... low 4, anything else 5."""
    position = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return F.coalesce(F.nullif(position, F.lit(0)), F.lit(5))


def top_anomaly(mart_anomaly_candidates: DataFrame, metric_date: date | None = None) -> DataFrame:
    """The most urgent flagged move, of one day if given; no row when there is none."""
    rows = mart_anomaly_candidates.where("should_investigate")
    if metric_date is not None:
        rows = rows.where(F.col("metric_date") == F.lit(metric_date))
    return first_rows(rows, [severity_order(), F.desc("metric_date"), F.col("metric_name")], 1)


# --- daily evidence tables ---------------------------------------------------

def daily_failures(daily_transaction_mix: DataFrame) -> DataFrame:
    return (
        daily_transaction_mix.where("transaction_status = 'failed'")
        .groupBy("metric_date", "payment_method", "failure_reason")
        .agg(F.sum("transaction_count").alias("failed_count"))
    )


def daily_outcomes(daily_transaction_mix: DataFrame) -> DataFrame:
    return daily_transaction_mix.groupBy(
        "metric_date", "transaction_status", "payment_method", "service_category",
    ).agg(F.sum("transaction_count").alias("transaction_count"),
          F.sum("completed_amount").cast("decimal(28,2)").alias("completed_amount"))


def daily_roles(mart_user_transaction_activity: DataFrame) -> DataFrame:
    """Average of the users' failure rates, summed exactly: the same over any shuffle."""
    return mart_user_transaction_activity.groupBy("metric_date", "role").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("failed_transactions").alias("failed_transactions"),
        F.sum("total_transactions").alias("total_transactions"),
        exact_avg(F.col("transaction_failure_rate")).alias("avg_failure_rate"))


DERIVED = {"daily_failures": (daily_failures, "daily_transaction_mix"),
           "daily_outcomes": (daily_outcomes, "daily_transaction_mix"),
           "daily_roles": (daily_roles, "mart_user_transaction_activity")}


# --- evidence lists -----------------------------------------------------------

@dataclass(frozen=True)
class Section:
    """One evidence list: rows of ``source`` on the day, or over the trend days."""

    name: str
    source: str
    measures: str = "*"
    key: str = ""
    order: str = ""
    limit: int = MAX_RECORDS
    trend: bool = False


# Evidence lists by kind of investigation.
PLAN_CONTEXT = Section("plan_context", "mart_plan_performance", key="plan_id", order="plan_id")
SECTIONS: dict[str, list[Section]] = {
    "transaction": [
        Section("transaction_health_trend", "mart_transaction_health", trend=True),
        Section("plan_performance", "mart_plan_performance",
                "total_transactions failed_transactions transaction_failure_rate "
                "completed_transaction_volume", "plan_id", "plan_id"),
        Section("user_activity_by_role", "daily_roles",
                "users failed_transactions total_transactions avg_failure_rate", "role",
                "-avg_failure_rate role"),
        Section("failure_breakdown", "daily_failures", "failed_count", "payment_method failure_reason",
                "-failed_count payment_method failure_reason", limit=20),
        Section("transaction_summary", "daily_outcomes", "transaction_count completed_amount",
                "transaction_status payment_method service_category",
                "-transaction_count transaction_status payment_method service_category", limit=20),
    ],
    "revenue": [
        Section("mrr_trend", "mart_mrr", trend=True),
        Section("plan_performance", "mart_plan_performance",
                "active_subscriptions mrr churn_rate completed_transaction_volume "
                "transaction_failure_rate", "plan_id", "plan_id"),
        Section("daily_kpis", "mart_daily_kpis",
                "mrr completed_transaction_volume active_subscriptions", trend=True),
    ],
    "churn": [
        Section("churn_trend", "mart_churn", trend=True),
        Section("plan_performance", "mart_plan_performance",
                "active_subscriptions cancelled_subscriptions churn_rate mrr", "plan_id", "plan_id"),
    ],
    "engagement": [
        Section("engagement_trend", "mart_user_engagement", trend=True),
        Section("top_features", "mart_feature_adoption",
                "active_feature_users total_feature_events feature_event_failure_rate", "feature_id",
                "-total_feature_events feature_id", limit=15),
    ],
}


def _order(words: str) -> list[Column]:
    return [F.desc_nulls_last(w[1:]) if w.startswith("-") else F.asc_nulls_last(w) for w in words.split()]


def _around(source: DataFrame, dates: date | DataFrame, trend: bool) -> DataFrame:
    """Source rows belonging to each wanted day, stamped with that day."""
    rows = source.withColumnRenamed("metric_date", "evidence_date")
    if isinstance(dates, DataFrame):
        # Eight keys per wanted day turn the date range into an equi-join.
        wanted = F.sequence(F.date_sub("metric_date", TREND_DAYS), F.col("metric_date")) if trend \
            else F.array("metric_date")
        return rows.join(dates.select("metric_date", F.explode(wanted).alias("evidence_date")), "evidence_date")
    day = F.lit(dates)
    first = F.date_sub(day, TREND_DAYS) if trend else day
    return rows.where(F.col("evidence_date").between(first, day)).withColumn("metric_date", day)


def _source(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    if name in DERIVED:
        function, table = DERIVED[name]
        return function(tables[table])
    return tables[name]


def section_rows(tables: Mapping[str, DataFrame], section: Section, dates: date | DataFrame) -> DataFrame:
    source = _source(tables, section.source)
    keys = section.key.split()
    measures = section.measures.split()
    if measures == ["*"]:
        measures = [c for c in source.columns if c not in ("metric_date", *keys)]
    order = _order("evidence_date" if section.trend else section.order)
    numbered = rank_within(_around(source, dates, section.trend), ["metric_date"], order, section.limit)
    key = F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("-")) for k in keys]) if keys else F.lit("")
    return melt(numbered, ["metric_date", F.lit(section.name).alias("section"), "record_no",
                           "evidence_date", key.alias("record_key")], measures)


def evidence(tables: Mapping[str, DataFrame], sections: Sequence[Section], dates: date | DataFrame) -> DataFrame:
    out = None
    for section in sections:
        rows = section_rows(tables, section, dates)
        out = rows if out is None else out.unionByName(rows)
    return out


def investigate_all(tables: Mapping[str, DataFrame], flagged: DataFrame) -> DataFrame:
    """Evidence for every flagged move in one job.

    Lists are computed once per (kind, day) and then attached to the moves of
    that kind and day, so moves sharing a day share the work.
    """
    moves = flagged.select("metric_date", "metric_name", "investigation_type")
    plan = section_rows(tables, PLAN_CONTEXT, moves.select("metric_date").distinct())
    out = moves.join(plan, "metric_date")
    for kind, sections in SECTIONS.items():
        of_kind = moves.where(F.col("investigation_type") == kind)
        rows = evidence(tables, sections, of_kind.select("metric_date").distinct())
        out = out.unionByName(of_kind.join(rows, "metric_date"))
    return out


# --- reports ------------------------------------------------------------------

def _latest(source: DataFrame, dates: date | DataFrame, *columns: str) -> DataFrame:
    """Last trend row up to each day."""
    rows = _around(source.select("metric_date", *columns), dates, trend=True)
    return rows.groupBy("metric_date").agg(*[F.max_by(c, "evidence_date").alias(c) for c in columns])


def report_text(tables: Mapping[str, DataFrame], flagged: DataFrame, only: date | None = None) -> DataFrame:
    """A report per flagged move: summary sentence and bullets, all as columns.

    When all moves are of one day, naming it in ``only`` spares the join with the days.
    """
    dates = flagged.select("metric_date").distinct() if only is None else only
    failures = rank_within(_around(daily_failures(tables["daily_transaction_mix"]), dates, False), ["metric_date"],
                           _order("-failed_count payment_method failure_reason"), 1)
    plans = _around(tables["mart_plan_performance"], dates, False)
    worst = rank_within(plans.where("transaction_failure_rate > 0"), ["metric_date"],
                        _order("-transaction_failure_rate plan_id"), 1)
    planned = plans.groupBy("metric_date").agg(F.lit(True).alias("has_plans"))
    rows = (
        flagged
        .join(failures.select("metric_date", "payment_method", "failure_reason", "failed_count"), "metric_date", "left")
        .join(worst.select("metric_date", "plan_id", F.col("transaction_failure_rate").alias("plan_rate")),
              "metric_date", "left")
        .join(planned, "metric_date", "left")
        .join(_latest(tables["mart_churn"], dates, "daily_churn_rate"), "metric_date", "left")
        .join(_latest(tables["mart_user_engagement"], dates, "daily_active_users", "events_per_active_user"),
              "metric_date", "left")
    )

    def bullet(kind: str | None, present: Column, *parts: str | Column) -> Column:
        applies = present if kind is None else (F.col("investigation_type") == kind) & present
        return F.when(applies, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in ("- ", *parts)]))

    # The sentences of a report.
    bullets = F.array_compact(F.array(
        bullet("transaction", F.col("failed_count").isNotNull(),
               "Top failure pattern: ", F.coalesce("failure_reason", F.lit("None")), " via ",
               F.coalesce("payment_method", F.lit("None")), " (", F.col("failed_count").cast("string"), " failures)."),
        bullet(None, F.col("plan_id").isNotNull(),
               "Highest plan failure rate: ", F.col("plan_id"), " at ", percent(F.col("plan_rate")), "."),
        bullet("revenue", F.col("has_plans").isNotNull(),
               "Plan-level MRR and subscription counts were pulled for the anomaly date."),
        bullet("churn", F.col("daily_churn_rate").isNotNull(),
               "Daily churn rate on anomaly date: ", percent(F.col("daily_churn_rate"), 2), "."),
        bullet("engagement", F.col("daily_active_users").isNotNull(),
               "Daily active users: ", F.col("daily_active_users").cast("string"), " with ",
               fixed(F.col("events_per_active_user"), 2), " events per active user."),
    ))
    none_found = "- Supporting mart queries were run, but no strong pattern emerged in the evidence."
    change = F.coalesce(signed(percent(F.col("percent_change"))), signed(fixed(F.col("absolute_change"), 4)))
    day = F.col("metric_date").cast("string")
    summary = F.concat(
        display_name(F.col("metric_name")), F.lit(" moved from "), fixed(F.col("previous_value"), 4),
        F.lit(" to "), fixed(F.col("current_value"), 4), F.lit(" ("), change, F.lit(") on "), day, F.lit("."))
    found = F.when(F.size(bullets) > 0, F.array_join(bullets, "\n")).otherwise(none_found)
    texts = rows.select("metric_date", "metric_name", "metric_category", "severity", "investigation_type",
                        summary.alias("summary"), found.alias("evidence"))
    cause = F.when(
        F.size(F.split("evidence", "\n")) > 1, "Several of the signals below moved on the same day and may share a cause."
    ).when(F.col("evidence") == none_found, "The stored tables show no driver of this move.").otherwise(
        "The signal below is the only one that stood out on that day and the first candidate to check.")
    body = F.concat_ws(
        "\n", F.lit("# Investigation Report"), F.lit(""), F.lit("## Anomaly Summary"), F.col("summary"), F.lit(""),
        F.concat(F.lit("Severity: "), F.col("severity"), F.lit(", category: "), F.col("metric_category")), F.lit(""),
        F.lit("## Likely Root Cause"), cause, F.lit(""),
        F.lit("## Supporting Evidence"), F.col("evidence"), F.lit(""),
        F.lit("## Recommended Next Steps"),
        F.concat(F.lit("- Look into the source records of "), day, F.lit(".")),
        F.lit("- See whether the next day's value returns to its usual level."),
        F.lit("- Ask for this report again once the next batch is in."))
    return texts.withColumn("report", body)
