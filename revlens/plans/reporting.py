"""Reporting models at day, plan-day, feature-day, user-day and account grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.columns import clamp, flag, ratio, sum_where, zero
from revlens.operators.calendar import all_bounds, fill_days, on_every_day
from revlens.operators.reshape import stack_days
from revlens.operators.sweep import open_intervals
from revlens.plans.core import PLANS, last_spine_day, subscription_bounds, subscription_lifespans

# Feature categories counted per day, roles counted per feature.
FEATURE_CATEGORIES = ("core", "billing", "payments", "scheduling", "crm", "automation",
                      "reporting", "operations", "integrations")
FEATURE_ROLES = ("owner", "admin", "staff")

MONEY = "decimal(28,2)"


def _total(name: str) -> Column:
    return F.sum(name).alias(name)


def subscription_days(plan_days: DataFrame, dim_plans: DataFrame) -> DataFrame:
    """All subscription measures per day, from one grouping of the plan days.

    A sum over rows without any price is NULL, as a plain SUM would give. New
    subscriptions count once per price of their plan, as in the plan table.
    """
    active, gone = F.col("active_subscriptions"), F.col("cancelled_subscriptions")

    def of_plan(plan: str, value: Column) -> Column:
        return F.coalesce(sum_where(F.col("plan_id") == plan, value), F.lit(0))

    unpriced = active - F.col("priced")
    prices = dim_plans.groupBy("plan_id").agg(F.count(F.lit(1)).alias("prices"))
    return plan_days.join(prices, "plan_id", "left").groupBy("metric_date").agg(
        F.sum(active).alias("active_subscriptions"),
        F.when(F.sum("priced") > 0, F.sum("mrr")).cast(MONEY).alias("mrr"),
        *[F.when(F.sum(active) > of_plan(p, unpriced), of_plan(p, F.col("mrr")))
          .cast(MONEY).alias(f"{p}_mrr") for p in PLANS],
        *[of_plan(p, active).alias(f"active_{p}_subscriptions") for p in PLANS],
        F.sum(gone).alias("cancelled_subscriptions"),
        *[of_plan(p, gone).alias(f"{p}_cancellations") for p in PLANS],
        F.sum(F.col("new_subscriptions") * zero("prices")).alias("new_subscriptions"),
        ratio(F.sum(gone), F.sum(active)).alias("daily_churn_rate"),
    )


def mart_mrr(subscription_days: DataFrame) -> DataFrame:
    """Days with at least one active subscription."""
    return subscription_days.where("active_subscriptions > 0").select(
        "metric_date", "active_subscriptions", "mrr", *[f"{p}_mrr" for p in PLANS],
        *[f"active_{p}_subscriptions" for p in PLANS],
    ).orderBy("metric_date")


def mart_churn(subscription_days: DataFrame) -> DataFrame:
    """Cancellations over the active subscriptions of the same day; cancellation
    days without any active subscription are left out."""
    return subscription_days.where("active_subscriptions > 0").select(
        "metric_date", "active_subscriptions", "cancelled_subscriptions",
        *[f"{p}_cancellations" for p in PLANS], "daily_churn_rate",
    ).orderBy("metric_date")


def mart_transaction_health(user_day_transactions: DataFrame) -> DataFrame:
    """Rolled up from the user days, so that the fact is not scanned again; rows are
    counted, as ids are declared not null."""
    failed, total = F.sum("failed_transactions"), F.sum("total_transactions")
    return user_day_transactions.groupBy("metric_date").agg(
        total.alias("total_transactions"),
        _total("completed_transactions"),
        failed.alias("failed_transactions"),
        _total("refunded_transactions"),
        F.sum("completed_volume").cast(MONEY).alias("completed_transaction_volume"),
        ratio(failed, total).alias("transaction_failure_rate"),
    ).orderBy("metric_date")


def mart_user_transaction_activity(user_day_transactions: DataFrame, dim_users: DataFrame) -> DataFrame:
    """Known users' active days: aggregate first, then attach user attributes.

    Transactions are counted as rows; their ids are declared not null and checked so.
    """
    users = dim_users.select("user_id", "role", "user_status", "device_preference", "onboarding_completed")
    return user_day_transactions.where("metric_date is not null").join(users, "user_id").select(
        "user_id", "role", "user_status", "device_preference", "onboarding_completed", "metric_date",
        "total_transactions", "completed_transactions", "failed_transactions",
        F.col("completed_volume").alias("completed_transaction_volume"),
        ratio(F.col("failed_transactions"), F.col("total_transactions"))
        .alias("transaction_failure_rate"),
    )


def mart_user_engagement(user_day_usage: DataFrame, dim_features: DataFrame, dim_users: DataFrame) -> DataFrame:
    """Every day of the event range. Distinct users are counted as rows of the
    user x day grain, so one shuffle serves all of them.

    Users are joined before grouping: rows hashed by user for the join need no
    further exchange to be grouped by user and day.
    """
    category = F.col("feature_category")
    per_user = (
        user_day_usage.join(dim_features.select("feature_id", "feature_category"), "feature_id", "left")
        .join(dim_users.select("user_id", "onboarding_completed"), "user_id", "left")
        .groupBy("metric_date", "user_id", "onboarding_completed").agg(
            _total("events"), _total("failed_events"), _total("mobile_events"),
            *[zero(sum_where(category == c, F.col("events"))).alias(f"{c}_events")
              for c in FEATURE_CATEGORIES])
    )
    known = F.col("user_id").isNotNull()
    users = F.count_if(known)
    onboarded = F.count_if(known & F.col("onboarding_completed"))
    daily = (
        per_user.groupBy("metric_date").agg(
            users.alias("daily_active_users"),
            F.sum("events").alias("total_events"),
            ratio(F.sum("events"), users).alias("events_per_active_user"),
            ratio(F.sum("failed_events"), F.sum("events")).alias("event_failure_rate"),
            onboarded.alias("onboarded_active_users"),
            ratio(onboarded, users).alias("onboarded_active_user_rate"),
            F.count_if(known & (F.col("mobile_events") > 0)).alias("active_mobile_users"),
            *[_total(f"{c}_events") for c in FEATURE_CATEGORIES])
    )
    filled = fill_days(daily)
    return filled.select("metric_date", *[zero(c).alias(c) for c in filled.columns[1:]])


def feature_sessions(fact_product_events: DataFrame) -> DataFrame:
    return fact_product_events.groupBy(F.col("event_date").alias("metric_date"), "feature_id") \
        .agg(F.count_distinct("session_id").alias("feature_sessions"))


def mart_feature_adoption(user_day_usage: DataFrame, feature_sessions: DataFrame,
                          dim_features: DataFrame, dim_users: DataFrame,
                          event_bounds: DataFrame) -> DataFrame:
    """Every feature on every day of the event range.

    Events of features outside the catalogue meet no calendar row and drop out.
    """
    known = F.col("user_id").isNotNull()
    users = F.count_if(known)
    used = (
        user_day_usage
        .join(dim_users.select("user_id", "role", "onboarding_completed", "is_active_user",
                               "is_new_user_30d"), "user_id", "left")
        .groupBy("metric_date", "feature_id").agg(
            F.sum("events").alias("total_feature_events"),
            users.alias("active_feature_users"),
            F.sum("successful_events").alias("successful_feature_events"),
            F.sum("failed_events").alias("failed_feature_events"),
            *[sum_where(F.col("role") == r, F.col("events")).alias(f"{r}_feature_events")
              for r in FEATURE_ROLES],
            F.count_if(known & F.col("onboarding_completed")).alias("onboarded_feature_users"),
            F.count_if(known & F.col("is_active_user")).alias("active_users_using_feature"),
            F.count_if(known & F.col("is_new_user_30d")).alias("new_users_using_feature"),
            _total("desktop_events"), _total("mobile_events"), _total("tablet_events"),
            ratio(F.sum("events"), users).alias("events_per_active_user"),
            ratio(F.sum("failed_events"), F.sum("events")).alias("feature_event_failure_rate"))
    )
    labels = ["feature_name", "feature_category", "minimum_plan", "is_core_feature"]
    calendar = on_every_day(dim_features.select("feature_id", *labels), event_bounds)
    measures = [
        "total_feature_events", "active_feature_users", "feature_sessions",
        "successful_feature_events", "failed_feature_events",
        *[f"{r}_feature_events" for r in FEATURE_ROLES],
        "onboarded_feature_users", "active_users_using_feature", "new_users_using_feature",
        "desktop_events", "mobile_events", "tablet_events",
        "events_per_active_user", "feature_event_failure_rate",
    ]
    return (
        calendar.join(used, ["metric_date", "feature_id"], "left")
        .join(feature_sessions, ["metric_date", "feature_id"], "left")
        .select("metric_date", "feature_id", *labels, *[zero(m).alias(m) for m in measures])
    )


def account_day_activity(user_day_transactions: DataFrame, user_day_usage: DataFrame,
                         dim_users: DataFrame) -> DataFrame:
    """Account x day transactions and events of the account's users.

    ``user_id`` is unique among users (a declared check), so users can be counted
    per account and added up. Both kinds of activity meet users in one join, and
    rows hashed by user for it are grouped by user and day in place.
    """
    measures = ("total_transactions", "completed_transactions", "failed_transactions",
                "completed_volume", "events", "failed_events")
    activity = user_day_transactions.select("user_id", "metric_date", *measures[:4]).unionByName(
        user_day_usage.select("user_id", "metric_date", *measures[4:]), allowMissingColumns=True)
    users = dim_users.select("user_id", "account_id", "onboarding_completed")
    per_user = activity.join(users, "user_id").groupBy(
        "user_id", "metric_date", "account_id", "onboarding_completed").agg(*[_total(c) for c in measures])
    active = F.col("events").isNotNull()
    return per_user.groupBy("account_id", "metric_date").agg(
        *[_total(c) for c in measures],
        F.count_if(active).alias("active_users"),
        F.count_if(active & F.col("onboarding_completed")).alias("onboarded_users"),
    )


def plan_day_activity(account_day_activity: DataFrame, stg_subscriptions: DataFrame) -> DataFrame:
    """Plan x day activity of accounts with an active subscription to the plan.

    An account with n active subscriptions to a plan counts its transactions and
    events n times for it, its users once. Activity of an account without an
    active subscription that day belongs to no plan.

    Subscriptions are swept as +/- counts along the account's active days, so only days
    with activity are produced, once for each plan of the account.
    """
    measures = ("total_transactions", "completed_transactions", "failed_transactions", "events", "failed_events",
                "completed_volume", "active_users", "onboarded_users")
    paid = subscription_lifespans(stg_subscriptions).where("is_paying")
    active = account_day_activity.where(F.col("metric_date") <= last_spine_day(stg_subscriptions))
    n = F.col("n_active")
    held = open_intervals(active.select("account_id", "metric_date", *measures), paid, "account_id", "plan_id",
                          "metric_date", "first_day", "cancelled_day", "n_active")
    return held.groupBy("metric_date", "plan_id").agg(
        *[F.sum(F.col(c) * n).alias(c) for c in measures[:5]],
        F.sum(F.col("completed_volume") * n.cast("decimal(9,0)")).cast(MONEY).alias("completed_volume"),
        _total("active_users"), _total("onboarded_users"),
    )


def mart_plan_performance(plan_days: DataFrame, plan_day_activity: DataFrame, dim_plans: DataFrame,
                          stg_subscriptions: DataFrame, transaction_bounds: DataFrame,
                          event_bounds: DataFrame) -> DataFrame:
    """Every plan on every day covered by subscriptions, transactions or events."""
    covered = all_bounds(subscription_bounds(stg_subscriptions), transaction_bounds, event_bounds)
    calendar = on_every_day(dim_plans.select("plan_id"), covered)
    by_plan = plan_days.groupBy("metric_date").agg(
        *[sum_where(F.col("plan_id") == p, F.col("mrr")).alias(f"{p}_mrr") for p in PLANS])
    active, gone = zero("active_subscriptions"), zero("cancelled_subscriptions")
    money = [zero(f"{p}_mrr").cast(MONEY).alias(f"{p}_mrr") for p in PLANS]
    return (
        calendar.join(plan_days, ["metric_date", "plan_id"], "left")
        .join(plan_day_activity, ["metric_date", "plan_id"], "left")
        .join(by_plan, "metric_date", "left")
        .select(
            "metric_date", "plan_id",
            active.alias("active_subscriptions"),
            zero("new_subscriptions").alias("new_subscriptions"),
            gone.alias("cancelled_subscriptions"),
            ratio(gone, active).alias("churn_rate"),
            zero("mrr").cast(MONEY).alias("mrr"),
            ratio(zero("mrr"), active).alias("avg_revenue_per_subscription"),
            zero("total_transactions").alias("total_transactions"),
            zero("completed_transactions").alias("completed_transactions"),
            zero("failed_transactions").alias("failed_transactions"),
            zero(ratio(F.col("failed_transactions"), F.col("total_transactions")))
            .alias("transaction_failure_rate"),
            zero("completed_volume").cast(MONEY).alias("completed_transaction_volume"),
            zero("events").alias("total_product_events"),
            zero("active_users").alias("active_users"),
            zero(ratio(F.col("events"), F.col("active_users"))).alias("events_per_active_user"),
            zero(ratio(F.col("failed_events"), F.col("events"))).alias("event_failure_rate"),
            zero("onboarded_users").alias("active_onboarded_users"),
            zero(ratio(F.col("onboarded_users"), F.col("active_users")))
            .alias("onboarded_active_user_rate"),
            *money,
        )
    )


def mart_account_health(dim_accounts: DataFrame, dim_users: DataFrame, stg_subscriptions: DataFrame,
                        user_day_transactions: DataFrame, user_day_usage: DataFrame) -> DataFrame:
    """Account state on the last day of subscription data, with the 30 days up to
    it. Activity is reduced to user grain before it meets users and accounts."""
    lives = subscription_lifespans(stg_subscriptions)
    as_of = subscription_bounds(stg_subscriptions).select("last").scalar()
    recent = F.col("metric_date").between(F.date_sub(as_of, 29), as_of)

    usage = user_day_usage.where(recent).groupBy("user_id").agg(_total("events"), _total("failed_events"))
    tx = user_day_transactions.where(recent).groupBy("user_id").agg(
        _total("total_transactions"), _total("failed_transactions"), _total("completed_volume"))
    active_now = F.col("events").isNotNull()
    of_users = (
        dim_users.join(usage, "user_id", "left").join(tx, "user_id", "left")
        .groupBy("account_id").agg(
            F.count(F.lit(1)).alias("total_users"),
            F.count_if("is_active_user").alias("active_users"),
            F.count_if("onboarding_completed").alias("onboarded_users"),
            F.count_if("is_recently_active_user").alias("recently_active_users"),
            F.count_if(active_now).alias("active_users_30d"),
            F.sum("events").alias("total_events_30d"),
            ratio(F.sum("failed_events"), F.sum("events")).alias("event_failure_rate_30d"),
            F.sum("total_transactions").alias("total_transactions_30d"),
            F.sum("failed_transactions").alias("failed_transactions_30d"),
            F.sum("completed_volume").alias("completed_volume_30d"))
    )
    paying = (F.col("is_paying") & (F.col("first_day") <= as_of)
              & (F.col("cancelled_day").isNull() | (F.col("cancelled_day") > as_of)))
    of_subs = lives.where(paying).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("active_subscriptions"), F.sum("monthly_price").alias("current_mrr"))

    counts = ["total_users", "active_users", "onboarded_users", "recently_active_users"]
    return (
        dim_accounts.join(of_users, "account_id", "left").join(of_subs, "account_id", "left")
        .select(
            "account_id", "account_name", "industry", "company_size", "region",
            "acquisition_channel", "account_status", "signup_date",
            as_of.alias("as_of_date"),
            *[zero(c).alias(c) for c in counts],
            zero("active_subscriptions").alias("active_subscriptions"),
            zero("current_mrr").cast(MONEY).alias("current_mrr"),
            *[zero(c).alias(c) for c in ("active_users_30d", "total_events_30d",
                                         "event_failure_rate_30d", "total_transactions_30d",
                                         "failed_transactions_30d")],
            zero("completed_volume_30d").cast(MONEY).alias("completed_volume_30d"),
            ratio(zero("failed_transactions_30d"), zero("total_transactions_30d"))
            .alias("transaction_failure_rate_30d"),
            flag((F.col("account_status") == "churned")
                 | ((zero("current_mrr") > 0) & (zero("active_users_30d") == 0))).alias("is_at_risk"),
        )
    )


def daily_features(mart_feature_adoption: DataFrame) -> DataFrame:
    """Feature adoption rolled up to days. Users are added up over features, so
    a user of two features counts twice."""
    used = F.count_distinct(F.when(F.col("total_feature_events") > 0, F.col("feature_id")))
    return mart_feature_adoption.groupBy("metric_date").agg(
        _total("total_feature_events"), _total("active_feature_users"),
        ratio(F.sum("failed_feature_events"), F.sum("total_feature_events"))
        .alias("feature_event_failure_rate"),
        ratio(used, F.count_distinct("feature_id")).alias("feature_adoption_rate"))


def mart_daily_kpis(subscription_days: DataFrame, mart_transaction_health: DataFrame,
                    mart_user_engagement: DataFrame, mart_feature_adoption: DataFrame) -> DataFrame:
    """One row per calendar day with the headline KPIs and their daily changes.

    The daily series are stacked and grouped once instead of joined one by one.
    The calendar runs over the days with transactions, events or an active
    subscription. New subscriptions are shown on those days but, like
    cancellations without any active subscription, do not extend it.
    """
    inside = F.lit(True).alias("in_calendar")
    running = F.col("active_subscriptions") > 0
    days = stack_days(
        "metric_date",
        subscription_days.select(
            "metric_date", "new_subscriptions",
            *[F.when(running, F.col(c)).alias(c) for c in ("mrr", "active_subscriptions",
                                                          "cancelled_subscriptions")],
            F.when(running, F.col("daily_churn_rate")).alias("churn_rate"),
            F.when(running, True).alias("in_calendar")),
        mart_transaction_health.select(
            "metric_date", "total_transactions", "completed_transactions", "failed_transactions",
            "transaction_failure_rate", "completed_transaction_volume", inside),
        mart_user_engagement.select(
            "metric_date", "daily_active_users", F.col("total_events").alias("total_product_events"),
            "events_per_active_user", "event_failure_rate", inside),
        daily_features(mart_feature_adoption).select("*", inside),
    )
    every = Window.partitionBy(F.lit(1))
    marked = F.when(F.col("in_calendar"), F.col("metric_date"))
    days = (
        days.withColumn("_first", F.min(marked).over(every)).withColumn("_last", F.max(marked).over(every))
        .where("metric_date between _first and _last").drop("_first", "_last", "in_calendar")
    )
    base = fill_days(days)
    base = base.select("metric_date", *[
        (zero(c).cast(MONEY) if c in ("mrr", "completed_transaction_volume") else zero(c)).alias(c)
        for c in base.columns if c != "metric_date"])
    return score_days(base)


def score_days(base: DataFrame) -> DataFrame:
    """Day-over-day changes, health score and anomaly mark of a gap-free series."""
    by_day = Window.orderBy("metric_date")

    def change(name: str) -> Column:
        return F.col(name) - F.lag(name).over(by_day)

    mrr_before = F.lag("mrr").over(by_day)
    moved = base.select(
        "*",
        change("mrr").alias("mrr_dod_change"),
        ratio(F.col("mrr") - mrr_before, mrr_before).alias("mrr_dod_pct_change"),
        change("daily_active_users").alias("daily_active_users_dod_change"),
        change("transaction_failure_rate").alias("transaction_failure_rate_dod_change"),
        change("churn_rate").alias("churn_rate_dod_change"),
        # |change| > 10 % of the previous MRR, compared exactly in decimals.
        flag((mrr_before != 0) & (F.abs(F.col("mrr") - mrr_before) * 10 > F.abs(mrr_before)))
        .alias("_mrr_jump"),
    )
    changes = ["mrr_dod_change", "mrr_dod_pct_change", "daily_active_users_dod_change",
               "transaction_failure_rate_dod_change", "churn_rate_dod_change"]
    settled = moved.select(
        *[c for c in moved.columns if c not in changes],
        *[(zero(c).cast(MONEY) if c == "mrr_dod_change" else zero(c)).alias(c) for c in changes])
    # Weights and slopes of the health score, anomaly limits.
    score = (
        clamp(50 + F.col("mrr_dod_pct_change") * 100, 0, 100) * F.lit(0.30)
        + clamp(100 - F.col("churn_rate") * 1000, 0, 100) * F.lit(0.25)
        + clamp(100 - F.col("transaction_failure_rate") * 200, 0, 100) * F.lit(0.25)
        + clamp(100 - F.col("event_failure_rate") * 200, 0, 100) * F.lit(0.20)
    )
    anomaly = (
        F.col("_mrr_jump")
        | (F.abs("churn_rate_dod_change") > F.lit(0.02))
        | (F.abs("transaction_failure_rate_dod_change") > F.lit(0.05))
        | (F.abs("daily_active_users_dod_change") > 50)
    )
    return settled.select(
        "metric_date",
        "mrr", "active_subscriptions", "new_subscriptions", "cancelled_subscriptions", "churn_rate",
        "daily_active_users", "total_product_events", "events_per_active_user", "event_failure_rate",
        "total_transactions", "completed_transactions", "failed_transactions",
        "transaction_failure_rate", "completed_transaction_volume",
        "total_feature_events", "active_feature_users", "feature_event_failure_rate",
        "feature_adoption_rate",
        *changes,
        F.round(score.cast("decimal(20,12)"), 2).alias("overall_health_score"),
        flag(anomaly).alias("has_anomaly"),
    )
