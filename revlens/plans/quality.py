"""Declared data-quality checks, run as few aggregates as possible.

NULL is only ever a failure of ``not_null``; the other rules skip it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.plans.anomaly import METRICS
from revlens.plans.core import COMPANY_SIZES, PLANS
from revlens.plans.reporting import FEATURE_CATEGORIES
from revlens.sources.feature_catalogue import FEATURES

_FEATURE_NAMES = [f[0] for f in FEATURES]
_LEVELS = ["low", "medium", "high"]

# Accepted values by column name.
VOCABULARY = {
    "industry": ["consulting", "wellness", "cleaning", "auto_repair"],
    "company_size": list(COMPANY_SIZES),
    "region": ["CA", "TX", "NY", "FL", "WA"],
    "acquisition_channel": ["organic", "paid_search", "referral", "social", "partner"],
    "account_status": ["active", "inactive", "churned"],
    "transaction_status": ["completed", "failed", "refunded", "pending"],
    "payment_method": ["card", "ach", "wallet"],
    "role": ["owner", "admin", "staff", "billing_manager", "operations_manager"],
    "user_status": ["active", "invited", "deactivated"],
    "onboarding_segment": ["completed_onboarding", "not_completed_onboarding"],
    "device_preference": ["desktop", "mobile", "tablet", "mixed"],
    "billing_period": ["monthly", "annual"],
    "subscription_status": ["trialing", "active", "past_due", "cancelled"],
    "plan_id": list(PLANS),
    "minimum_plan": list(PLANS),
    "event_name": _FEATURE_NAMES,
    "feature_name": _FEATURE_NAMES,
    "feature_category": list(FEATURE_CATEGORIES),
    "feature_status": ["active", "beta", "deprecated"],
    "adoption_difficulty": _LEVELS,
    "retention_impact": _LEVELS,
    "adoption_segment": ["easy_adoption", "moderate_adoption", "hard_adoption"],
    "device_type": ["desktop", "mobile", "tablet"],
    "event_status": ["success", "failed"],
    "failure_reason": ["validation_error", "timeout", "permission_denied", "integration_error", "unknown"],
    "metric_name": [m[0] for m in METRICS],
    "metric_category": ["revenue", "retention", "engagement", "reliability"],
    "severity": ["none", "low", "medium", "high", "critical"],
    "anomaly_direction": ["up", "down", "flat"],
}


@dataclass(frozen=True)
class Checks:
    """Rules of one model. ``not_null`` lists columns, or "*" for all of them;
    columns prefixed with "-" are taken out again."""

    not_null: str
    unique: str | None = None
    accepted: str = ""
    parents: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def not_null_columns(self, columns: list[str]) -> list[str]:
        words = self.not_null.split()
        if words[0] != "*":
            return words
        return [c for c in columns if f"-{c}" not in words]


_ACCOUNT = {"account_id": ("stg_accounts", "account_id")}

# The checks declared for each model.
SUITE = {
    "stg_accounts": Checks("account_id signup_date", "account_id",
                           "industry company_size region acquisition_channel account_status"),
    "stg_users": Checks("user_id account_id onboarding_completed", "user_id", "role user_status", _ACCOUNT),
    "stg_subscriptions": Checks("subscription_id account_id plan_id monthly_price", "subscription_id",
                                "billing_period subscription_status", _ACCOUNT),
    "stg_features": Checks("feature_id feature_name is_core_feature released_at", "feature_id",
                           "feature_name feature_category minimum_plan feature_status "
                           "adoption_difficulty retention_impact"),
    "stg_product_events": Checks("event_id user_id session_id feature_id event_name event_timestamp",
                                 "event_id", "event_name device_type event_status failure_reason"),
    "stg_transactions": Checks("transaction_id user_id transaction_timestamp transaction_amount",
                               "transaction_id", "transaction_status payment_method"),
    "dim_accounts": Checks("account_id signup_date is_active_account is_churned_account", "account_id",
                           "industry company_size region acquisition_channel account_status"),
    "dim_users": Checks("user_id account_id is_active_user", "user_id",
                        "role user_status onboarding_segment"),
    "dim_plans": Checks("plan_id monthly_price plan_tier_rank available_feature_count", "plan_id"),
    "dim_features": Checks("feature_id feature_name feature_category is_core_feature is_active_feature",
                           "feature_id", "minimum_plan feature_status adoption_segment"),
    "fact_product_events": Checks("event_id user_id feature_id event_timestamp event_date", "event_id",
                                  "device_type event_status"),
    "fact_transactions": Checks("transaction_id user_id transaction_timestamp transaction_date "
                                "transaction_amount", "transaction_id", "transaction_status payment_method"),
    "mart_mrr": Checks("metric_date active_subscriptions mrr starter_mrr", "metric_date"),
    "mart_churn": Checks("metric_date", "metric_date"),
    "mart_transaction_health": Checks("metric_date total_transactions completed_transactions "
                                      "failed_transactions refunded_transactions", "metric_date"),
    "mart_user_transaction_activity": Checks(
        "user_id metric_date total_transactions completed_transactions failed_transactions",
        accepted="role user_status device_preference"),
    "mart_user_engagement": Checks("*", "metric_date"),
    "mart_feature_adoption": Checks("metric_date feature_id feature_name feature_category "
                                    "total_feature_events active_feature_users feature_sessions",
                                    accepted="minimum_plan"),
    "mart_plan_performance": Checks("* -churn_rate -avg_revenue_per_subscription", accepted="plan_id"),
    "mart_account_health": Checks("account_id as_of_date current_mrr is_at_risk", "account_id"),
    "mart_daily_kpis": Checks("*", "metric_date"),
    "mart_anomaly_candidates": Checks("* -previous_value -absolute_change -percent_change",
                                      accepted="metric_name metric_category severity anomaly_direction"),
}


def column_failures(df: DataFrame, not_null: list[str], accepted: Mapping[str, list[str]]) -> DataFrame:
    """Failing rows of all column rules of a table in one scan: (column, rule, failures)."""
    rules = [(c, "not_null", F.col(c).isNull()) for c in not_null]
    rules += [(c, "accepted_values", ~F.col(c).isin(values)) for c, values in accepted.items()]
    counted = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.count_if(bad).alias("failures"))
        for c, rule, bad in rules]).alias("r"))
    return counted.select(F.inline("r"))


def not_null_failures(df: DataFrame, columns: list[str]) -> DataFrame:
    return column_failures(df, columns, {})


def accepted_failures(df: DataFrame, accepted: Mapping[str, list[str]]) -> DataFrame:
    return column_failures(df, [], accepted)


def unique_failures(df: DataFrame, column: str) -> DataFrame:
    """Number of values held by more than one row. Counting combines on the map
    side, so a value filling a third of the table is one row per task."""
    repeated = df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1")
    return repeated.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(column).alias("column"), F.lit("unique").alias("rule"), "failures")


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key has no parent."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def relationship_failures(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows without parent. Keys are counted before they are matched, so a
    key shared by very many children weighs one row."""
    per_key = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    lost = per_key.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures")).select(
        F.lit(column).alias("column"), F.lit("relationships").alias("rule"), "failures")


# Facts that hold the rows of their staging model one to one: the key is counted once for both.
SAME_ROWS = {"fact_product_events": "stg_product_events", "fact_transactions": "stg_transactions"}


def model_report(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """(model, column, rule, failures) of a model's checks; a fact's unique check comes with its staging model's."""
    df, checks = tables[name], SUITE[name]
    own = F.lit(name).alias("model")
    parts = [column_failures(df, checks.not_null_columns(df.columns),
                             {c: VOCABULARY[c] for c in checks.accepted.split()}).select(own, "*")]
    twins = [f for f, s in SAME_ROWS.items() if s == name and SUITE[f].unique == checks.unique]
    source = SAME_ROWS.get(name)
    if checks.unique and not (source and SUITE[source].unique == checks.unique):
        named = F.explode(F.array(*[F.lit(n) for n in (name, *twins)])).alias("model")
        parts.append(unique_failures(df, checks.unique).select(named, "*"))
    for column, (parent, parent_column) in checks.parents.items():
        parts.append(relationship_failures(df, column, tables[parent], parent_column).select(own, "*"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def quality_report(tables: Mapping[str, DataFrame], known: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Every declared check of every model: (model, column, rule, failures).

    Meant for stored tables: over lazy models each check would recompute them. ``known`` are
    reports that stand for some models, such as those kept as state by ``check_state``.
    """
    known = known or {}
    report = None
    for part in [*known.values(), *[model_report(tables, name) for name in SUITE if name not in known]]:
        report = part if report is None else report.unionByName(part)
    return report


class QualityError(RuntimeError):
    pass


def quality_gate(report: DataFrame) -> None:
    """Stop unless every check passes; all failing checks, of the few hundred declared, go into the message."""
    failed = report.where("failures > 0").orderBy(F.desc("failures"), "model", "column", "rule").collect()
    if failed:
        lines = [f"{r.model}.{r.column} {r.rule}: {r.failures}" for r in failed]
        raise QualityError("data-quality checks failed: " + "; ".join(lines))
