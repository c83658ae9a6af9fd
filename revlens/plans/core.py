"""Core models: dimensions, facts and the per-day subscription state."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import display_name, flag, month_of, one_if, rank_in, week_of
from revlens.operators.calendar import day_bounds, each_day
from revlens.operators.levels import daily_levels

# Ordered vocabularies behind the ranks.
PLANS = ("starter", "pro", "business")
COMPANY_SIZES = ("solo", "small", "mid_market")
# Statuses that count as paying on the days between start and cancellation.
# Status is the current one, applied to all past days.
PAYING_STATUSES = ("active", "past_due", "cancelled")


def _since(value: Column, as_of: date, days: int = 30) -> Column:
    return flag(value >= F.date_sub(F.lit(as_of), days))


def dim_accounts(stg_accounts: DataFrame, as_of: date) -> DataFrame:
    status = F.col("account_status")
    return stg_accounts.select(
        "account_id", "account_name",
        "industry", "company_size", "region", "acquisition_channel", "account_status",
        "signup_date",
        "created_at", F.to_date("created_at").alias("account_created_date"),
        "updated_at", F.to_date("updated_at").alias("account_updated_date"),
        *[display_name(F.col(c)).alias(f"{c}_display_name")
          for c in ("industry", "company_size", "acquisition_channel")],
        rank_in(F.col("company_size"), COMPANY_SIZES).alias("company_size_rank"),
        flag(status == "active").alias("is_active_account"),
        flag(status == "churned").alias("is_churned_account"),
        _since(F.col("signup_date"), as_of).alias("is_new_account_30d"),
    )


def dim_users(stg_users: DataFrame, as_of: date) -> DataFrame:
    return stg_users.select(
        "user_id", "account_id", "first_name", "last_name",
        F.concat_ws(" ", "first_name", "last_name").alias("full_name"),
        "email", "role", "user_status", "device_preference", "notification_preference",
        "user_timezone", "onboarding_completed",
        "created_at", F.to_date("created_at").alias("user_created_date"),
        "last_login_at", F.to_date("last_login_at").alias("last_login_date"),
        F.when(F.col("onboarding_completed"), "completed_onboarding")
         .otherwise("not_completed_onboarding").alias("onboarding_segment"),
        flag(F.col("user_status") == "active").alias("is_active_user"),
        _since(F.col("last_login_at"), as_of).alias("is_recently_active_user"),
        _since(F.col("created_at"), as_of).alias("is_new_user_30d"),
    )


def dim_features(stg_features: DataFrame) -> DataFrame:
    flags = {
        "is_active_feature": F.col("feature_status") == "active",
        "is_beta_feature": F.col("feature_status") == "beta",
        "is_deprecated_feature": F.col("feature_status") == "deprecated",
        "is_starter_feature": F.col("minimum_plan") == "starter",
        "is_pro_feature": F.col("minimum_plan") == "pro",
        "is_business_feature": F.col("minimum_plan") == "business",
        "is_high_retention_feature": F.col("retention_impact") == "high",
    }
    difficulty = F.col("adoption_difficulty")
    return stg_features.select(
        "feature_id", "feature_name", "feature_category", "minimum_plan", "is_core_feature",
        "feature_status", "released_at", "adoption_difficulty", "retention_impact",
        rank_in(F.col("minimum_plan"), PLANS).alias("minimum_plan_tier_rank"),
        display_name(F.col("feature_name")).alias("feature_display_name"),
        *[flag(cond).alias(name) for name, cond in flags.items()],
        F.when(difficulty == "low", "easy_adoption")
         .when(difficulty == "medium", "moderate_adoption")
         .otherwise("hard_adoption").alias("adoption_segment"),
    )


def plan_features(stg_features: DataFrame) -> DataFrame:
    """Features available per plan: a plan has all features of its own and lower
    tiers, so every feature is listed under each plan it belongs to."""
    tier = rank_in(F.col("minimum_plan"), PLANS)
    from_tier_up = F.slice(F.array(*[F.lit(p) for p in PLANS]), tier, len(PLANS))
    return (
        stg_features.where(tier.isNotNull())
        .select("feature_id", "is_core_feature", F.explode(from_tier_up).alias("plan_id"))
        .groupBy("plan_id")
        .agg(F.count("feature_id").alias("available_feature_count"),
             F.count(F.when(F.col("is_core_feature"), F.col("feature_id")))
             .alias("available_core_feature_count"))
    )


def dim_plans(stg_subscriptions: DataFrame, stg_features: DataFrame) -> DataFrame:
    """One row per distinct (plan, price) found among the subscriptions.

    Feature counts follow the declared model, which counts a plan's features once
    per price of the plan; the unique check on plans reports such plans.
    """
    plan = F.col("plan_id")
    priced = stg_subscriptions.select("plan_id", "monthly_price").distinct()
    prices = priced.groupBy("plan_id").agg(F.count(F.lit(1)).alias("prices"))
    counts = ("available_feature_count", "available_core_feature_count")
    features = plan_features(stg_features).join(prices, "plan_id").select(
        "plan_id", *[(F.col(c) * F.col("prices")).alias(c) for c in counts])
    return priced.join(features, "plan_id", "left").select(
        "plan_id", "monthly_price",
        (F.col("monthly_price") * 12).cast("decimal(18,2)").alias("annual_price"),
        rank_in(plan, PLANS).alias("plan_tier_rank"),
        F.initcap(plan).alias("plan_display_name"),
        # A plan outside the vocabulary has no features; a NULL plan stays NULL.
        *[F.when(plan.isNotNull(), F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counts],
        flag(plan == "starter").alias("is_entry_level_plan"),
        flag(plan == "business").alias("is_enterprise_plan"),
    )


def fact_product_events(stg_product_events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    at, status = F.col("event_timestamp"), F.col("event_status")
    return stg_product_events.select(
        *keep, "event_id", "user_id", "session_id", "feature_id", "event_name",
        "event_timestamp", F.to_date(at).alias("event_date"),
        week_of(at).alias("event_week"), month_of(at).alias("event_month"),
        "device_type", "event_status", "failure_reason",
        flag(status == "success").alias("is_successful_event"),
        flag(status == "failed").alias("is_failed_event"),
        one_if(status == "success").alias("successful_event_count"),
        one_if(status == "failed").alias("failed_event_count"),
    )


def fact_transactions(stg_transactions: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    at, status, amount = (F.col(c) for c in
                          ("transaction_timestamp", "transaction_status", "transaction_amount"))
    return stg_transactions.select(
        *keep, "transaction_id", "user_id",
        "transaction_timestamp", F.to_date(at).alias("transaction_date"),
        week_of(at).alias("transaction_week"), month_of(at).alias("transaction_month"),
        "transaction_amount", "transaction_status", "payment_method", "service_category",
        "customer_type", "failure_reason", "refund_reason",
        *[flag(status == s).alias(f"is_{s}_transaction")
          for s in ("completed", "failed", "refunded", "pending")],
        F.when(status == "completed", amount).otherwise(F.lit(0).cast("decimal(18,2)"))
         .alias("completed_transaction_amount"),
        *[one_if(status == s).alias(f"{s}_transaction_count")
          for s in ("failed", "completed", "refunded")],
    )


# --- subscription state ---------------------------------------------------

def _latest_date() -> Column:
    return F.greatest(*[F.to_date(c) for c in ("started_at", "cancelled_at", "updated_at")])


def last_spine_day(stg_subscriptions: DataFrame) -> Column:
    """Last day of the subscription calendar: the latest date of any subscription."""
    return stg_subscriptions.agg(F.max(_latest_date()).alias("d")).scalar()


def subscription_lifespans(stg_subscriptions: DataFrame) -> DataFrame:
    """Subscriptions that exist on at least one day.

    The cancellation day is the last day with a row, but no longer a paying one.
    Without cancellation a subscription lasts to the end of the calendar.
    """
    return stg_subscriptions.select(
        "subscription_id", "account_id", "plan_id", "monthly_price",
        F.to_date("started_at").alias("first_day"),
        F.to_date("cancelled_at").alias("cancelled_day"),
        flag(F.col("subscription_status").isin(*PAYING_STATUSES)).alias("is_paying"),
    ).where("first_day <= coalesce(cancelled_day, first_day)")


def subscription_bounds(stg_subscriptions: DataFrame) -> DataFrame:
    """One row: first and last day ``fact_subs_by_day`` has rows for, from one
    aggregation of the subscriptions instead of their days."""
    started, cancelled = F.to_date("started_at"), F.to_date("cancelled_at")
    exists = started <= F.coalesce(cancelled, started)
    any_open = F.count_if(exists & cancelled.isNull()) > 0
    return stg_subscriptions.agg(
        F.min(F.when(exists, started)).alias("first"),
        F.when(any_open, F.max(_latest_date())).otherwise(F.max(F.when(exists, cancelled))).alias("last"))


def fact_subs_by_day(stg_subscriptions: DataFrame, only: Collection[date] | None = None) -> DataFrame:
    """Subscription x day, of some days ``only`` if they are given. Narrow: no join and
    no shuffle of the expanded rows."""
    day = F.col("metric_date")
    started, cancelled = F.to_date("started_at"), F.to_date("cancelled_at")
    first, last = started, F.coalesce(cancelled, last_spine_day(stg_subscriptions))
    if only is not None:
        first, last = F.greatest(started, F.lit(min(only))), F.least(last, F.lit(max(only)))
        stg_subscriptions = stg_subscriptions.where(started.isNotNull())
    alive = each_day(stg_subscriptions, first, last)
    if only is not None:
        alive = alive.where(day.isin(sorted(only)))
    paying = F.col("subscription_status").isin(*PAYING_STATUSES)
    return alive.select(
        "metric_date", "subscription_id", "account_id", "plan_id", "monthly_price",
        "billing_period", "subscription_status", "started_at", "cancelled_at", "cancel_reason",
        "payment_method", "auto_renew", "discount_percent", "sales_assisted",
        # Annual billing and discounts do not change the monthly price.
        F.col("monthly_price").alias("normalized_monthly_price"),
        flag(paying & (cancelled.isNull() | (cancelled > day))).alias("is_active_subscription"),
        flag(cancelled == day).alias("is_cancelled_on_date"),
        flag(started == day).alias("is_new_subscription_on_date"),
    )


def plan_days(stg_subscriptions: DataFrame) -> DataFrame:
    """Plan x day: active, new and cancelled subscriptions and MRR.

    Equal to grouping ``fact_subs_by_day`` but computed from start and
    cancellation changes, O(subscriptions) instead of O(subscriptions x days).
    ``priced`` counts the active subscriptions whose price is known.
    """
    lives = subscription_lifespans(stg_subscriptions)
    ends = F.col("cancelled_day").isNotNull()
    pays = F.col("is_paying") & (~ends | (F.col("cancelled_day") > F.col("first_day")))
    price = F.when(pays, F.coalesce(F.col("monthly_price"), F.lit(0)))
    priced = one_if(pays & F.col("monthly_price").isNotNull())

    def change(day: Column, sign: int, new: int, cancelled: int) -> Column:
        return F.struct(
            day.alias("metric_date"),
            (one_if(pays) * sign).alias("active_subscriptions"),
            (priced * sign).alias("priced"),
            (F.coalesce(price, F.lit(0)) * sign).cast("decimal(18,2)").alias("mrr"),
            F.lit(new).alias("new_subscriptions"),
            F.lit(cancelled).alias("cancelled_subscriptions"),
        )

    both = F.array(change(F.col("first_day"), 1, 1, 0), change(F.col("cancelled_day"), -1, 0, 1))
    only_start = F.array(change(F.col("first_day"), 1, 1, 0))
    changes = lives.select("plan_id", F.explode(F.when(ends, both).otherwise(only_start)).alias("c")) \
        .select("plan_id", "c.*")
    return daily_levels(
        changes, "plan_id", "metric_date",
        levels=("active_subscriptions", "priced", "mrr"),
        flows=("new_subscriptions", "cancelled_subscriptions"),
        last_day=last_spine_day(stg_subscriptions),
    )


# --- spans of the facts, one row each, from their pre-aggregates ---------------------------------------

def transaction_bounds(user_day_transactions: DataFrame) -> DataFrame:
    return day_bounds(user_day_transactions, "metric_date")


def event_bounds(user_day_usage: DataFrame) -> DataFrame:
    return day_bounds(user_day_usage, "metric_date")


# --- user x day pre-aggregates ---------------------------------------------

def user_day_transactions(fact_transactions: DataFrame) -> DataFrame:
    """User x day totals. Every later join to users or accounts works on this
    grain, so a user holding a large share of all rows weighs one row per day.

    Rows are counted, not transaction ids: ids are declared not null, and reading
    the widest column of the largest table only to count it would double the scan.
    """
    return fact_transactions.groupBy("user_id", F.col("transaction_date").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if("is_completed_transaction").alias("completed_transactions"),
        F.count_if("is_failed_transaction").alias("failed_transactions"),
        F.count_if("is_refunded_transaction").alias("refunded_transactions"),
        F.sum(F.when(F.col("is_completed_transaction"), F.col("transaction_amount")))
         .alias("completed_volume"),
    )


def daily_transaction_mix(fact_transactions: DataFrame) -> DataFrame:
    """Day x status x method x category x failure reason: a few hundred rows a day
    that all transaction evidence is drawn from."""
    return fact_transactions.groupBy(
        F.col("transaction_date").alias("metric_date"), "transaction_status", "payment_method",
        "service_category", "failure_reason",
    ).agg(F.count(F.lit(1)).alias("transaction_count"),
          F.sum("completed_transaction_amount").cast("decimal(28,2)").alias("completed_amount"))


def user_day_usage(fact_product_events: DataFrame) -> DataFrame:
    """User x day x feature event counts, the base of all distinct-user counts."""
    return fact_product_events.groupBy(
        "user_id", F.col("event_date").alias("metric_date"), "feature_id",
    ).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("successful_event_count").alias("successful_events"),
        F.sum("failed_event_count").alias("failed_events"),
        *[F.count_if(F.col("device_type") == d).alias(f"{d}_events")
          for d in ("desktop", "mobile", "tablet")],
    )
