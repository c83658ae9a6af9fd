"""Staging models: typed, case-normalised views of the raw tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.latest import latest_per_key
from revlens.sources.day_table import on_days
from revlens.sources.schemas import raw_schema


def _clean(raw: DataFrame, table: str, lower: str = "", upper: str = "") -> list[Column]:
    """Cast to the declared types; fold the case of categorical columns.

    ``try_cast`` turns a value that does not parse into NULL, which the
    not-null checks then report, instead of failing the whole job.
    """
    lowered, uppered = lower.split(), upper.split()
    out = []
    for field in raw_schema(table):
        if field.name == "batch_date":
            continue
        value = F.col(field.name)
        if raw.schema[field.name].dataType != field.dataType:
            value = value.try_cast(field.dataType)
        if field.name in lowered:
            value = F.lower(value)
        elif field.name in uppered:
            value = F.upper(value)
        out.append(value.alias(field.name))
    return out


def stg_accounts(raw_accounts: DataFrame) -> DataFrame:
    return raw_accounts.select(*_clean(
        raw_accounts, "raw_accounts",
        lower="industry company_size acquisition_channel account_status", upper="region"))


def stg_users(raw_users: DataFrame) -> DataFrame:
    return raw_users.select(*_clean(
        raw_users, "raw_users",
        lower="role user_status device_preference notification_preference user_timezone"))


def stg_features(raw_features: DataFrame) -> DataFrame:
    return raw_features.select(*_clean(
        raw_features, "raw_features",
        lower="feature_name feature_category minimum_plan feature_status "
              "adoption_difficulty retention_impact"))


def stg_product_events(raw_product_events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return raw_product_events.select(*keep, *_clean(
        raw_product_events, "raw_product_events",
        lower="event_name device_type event_status failure_reason"))


def stg_transactions(raw_transactions: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return raw_transactions.select(*keep, *_clean(
        raw_transactions, "raw_transactions",
        lower="transaction_status payment_method service_category customer_type "
              "failure_reason refund_reason"))


def _versions(raw_subscriptions: DataFrame) -> DataFrame:
    return raw_subscriptions.select(
        *_clean(raw_subscriptions, "raw_subscriptions",
                lower="plan_id billing_period subscription_status cancel_reason payment_method"),
        F.col("batch_date").try_cast("date").alias("batch_date"))


def _latest(versions: DataFrame) -> DataFrame:
    newest_first = [F.desc_nulls_last(c) for c in ("updated_at", "batch_date", "cancelled_at")]
    return latest_per_key(versions, "subscription_id", newest_first)


def latest_subscriptions(raw_subscriptions: DataFrame) -> DataFrame:
    """Latest version per subscription. Equal update times are broken by the
    later batch, then the later cancellation, so the choice is repeatable."""
    return _latest(_versions(raw_subscriptions))


def merged_subscriptions(state: DataFrame, raw_subscriptions: DataFrame, batches: Iterable[date | None]) -> DataFrame:
    """``latest_subscriptions`` from its stored rows and the batches that were loaded since.

    The batches' rows compete with the stored ones. Stored rows that came from one of these
    batches may be gone from it, so their subscriptions alone are looked up in all versions.
    """
    batches = list(batches)
    kept = on_days(state, "batch_date", batches)
    stale = kept.select("subscription_id").distinct()
    fresh = _versions(on_days(raw_subscriptions, "batch_date", batches))
    parts = state.join(stale, "subscription_id", "left_anti").unionByName(fresh)
    if not stale.isEmpty():
        parts = parts.unionByName(_versions(raw_subscriptions.join(stale, "subscription_id", "left_semi")))
    return _latest(parts)


def stg_subscriptions(latest_subscriptions: DataFrame) -> DataFrame:
    return latest_subscriptions.drop("batch_date")
