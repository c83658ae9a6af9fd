"""Subscription days: edge rows, and the change-based path against the expanded one."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revlens.plans import core, reporting, staging
from revlens.sources.schemas import raw_schema

START = date(2024, 1, 1)


def day(n):
    return None if n is None else date.fromordinal(START.toordinal() + n)


def at(n):
    return None if n is None else datetime.combine(day(n), datetime.min.time())


def raw(spark, *rows):
    """Rows of (id, plan, price, status, started, cancelled, updated[, account])."""
    names = raw_schema("raw_subscriptions").names
    full = []
    for sid, plan, price, status, started, cancelled, updated, *rest in rows:
        row = dict.fromkeys(names)
        row.update(subscription_id=sid, plan_id=plan, monthly_price=None if price is None else Decimal(price),
                   subscription_status=status, started_at=at(started), cancelled_at=at(cancelled),
                   updated_at=at(updated), account_id=rest[0] if rest else "a1", billing_period="monthly",
                   batch_date=day(updated if updated is not None else 0))
        full.append(tuple(row[n] for n in names))
    return spark.createDataFrame(full, raw_schema("raw_subscriptions"))


def staged(spark, *rows):
    return staging.stg_subscriptions(staging.latest_subscriptions(raw(spark, *rows)))


def test_latest_version_wins_and_null_update_is_last(spark):
    subs = staged(spark, ("s", "pro", 79, "active", 0, None, 0), ("s", "pro", 79, "cancelled", 0, 5, 5),
                  ("s", "pro", 79, "trialing", 0, None, None))
    assert [r.subscription_status for r in subs.collect()] == ["cancelled"]


def test_equal_update_times_are_broken_by_batch_then_cancellation(spark):
    same_batch = staged(spark, ("s", "pro", 79, "active", 0, None, 3), ("s", "pro", 79, "cancelled", 0, 3, 3))
    assert same_batch.first().cancelled_at is not None
    versions = raw(spark, ("s", "pro", 79, "active", 0, None, 3), ("s", "pro", 79, "cancelled", 0, 3, 3))
    later = versions.withColumn("batch_date", F.when(F.col("cancelled_at").isNull(), F.lit(day(9))).otherwise(F.lit(day(3))))
    assert staging.latest_subscriptions(later).first().cancelled_at is None


@pytest.mark.parametrize("started, cancelled, days, active", [
    (2, 2, 1, 0),        # cancelled on the start day: a row, never active
    (3, 1, 0, 0),        # cancelled before it started: no rows
    (None, None, 0, 0),  # never started
    (2, None, 9, 9),     # open-ended: to the end of the calendar
    (10, None, 1, 1),    # starts on the last day
    (4, 7, 4, 3),        # a row on the cancel day, active up to the day before
])
def test_days_of_one_subscription(spark, started, cancelled, days, active):
    # the second subscription pins the calendar to days 0..10
    subs = staged(spark, ("s", "pro", 79, "active", started, cancelled, 0), ("t", "pro", 79, "active", 0, 0, 10))
    rows = core.fact_subs_by_day(subs).where("subscription_id = 's'").collect()
    assert len(rows) == days and sum(r.is_active_subscription for r in rows) == active
    assert sum(r.is_cancelled_on_date for r in rows) == (1 if cancelled is not None and days else 0)
    assert sum(r.is_new_subscription_on_date for r in rows) == (1 if days else 0)


def test_trialing_has_days_but_is_never_active_and_past_due_is(spark):
    subs = staged(spark, ("s", "pro", 79, "trialing", 0, None, 3), ("t", "pro", 79, "past_due", 0, None, 3))
    rows = core.fact_subs_by_day(subs).collect()
    assert sum(r.is_active_subscription for r in rows if r.subscription_id == "s") == 0
    assert sum(r.is_active_subscription for r in rows if r.subscription_id == "t") == 4


def test_current_status_applies_to_the_past_and_annual_price_is_kept(spark):
    subs = staged(spark, ("s", "pro", 79, "active", 0, None, 0), ("s", "pro", 79, "cancelled", 0, 3, 3))
    days = core.fact_subs_by_day(subs.withColumn("billing_period", F.lit("annual"))
                                 .withColumn("discount_percent", F.lit(30).cast("decimal(5,2)"))).collect()
    assert [r.is_active_subscription for r in sorted(days)] == [True, True, True, False]
    assert {r.normalized_monthly_price for r in days} == {Decimal(79)}


def _from_days(facts):
    """The per-day measures grouped straight from the expanded fact."""
    active = F.col("is_active_subscription")
    price = F.when(active, F.col("monthly_price"))
    plan = {p: F.col("plan_id") == p for p in core.PLANS}
    return facts.groupBy("metric_date").agg(
        F.count_distinct(F.when(active, F.col("subscription_id"))).alias("active_subscriptions"),
        F.sum(price).alias("mrr"),
        *[F.sum(F.when(active, F.when(c, F.col("monthly_price")).otherwise(0))).alias(f"{p}_mrr") for p, c in plan.items()],
        F.count_distinct(F.when(F.col("is_cancelled_on_date"), F.col("subscription_id"))).alias("cancelled_subscriptions"),
    ).where("active_subscriptions > 0")


_sub = st.tuples(
    st.sampled_from(["starter", "pro", "business", "legacy", None]),
    st.sampled_from([29, 79, 199, None]),
    st.sampled_from(["active", "trialing", "past_due", "cancelled", None]),
    st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), st.integers(0, 14)), st.integers(0, 16))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_sub, min_size=1, max_size=12))
def test_changes_equal_expanded_days(spark, rows):
    subs = staged(spark, *[(f"s{i}", *r) for i, r in enumerate(rows)])
    facts = core.fact_subs_by_day(subs)
    features = spark.createDataFrame([], "feature_id string, is_core_feature boolean, minimum_plan string")
    days = reporting.subscription_days(core.plan_days(subs), core.dim_plans(subs, features))
    columns = ["metric_date", "active_subscriptions", "mrr", "starter_mrr", "pro_mrr", "business_mrr",
               "cancelled_subscriptions"]
    got = days.where("active_subscriptions > 0").select(*columns).collect()
    want = _from_days(facts).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    bounds = core.subscription_bounds(subs).first()
    span = facts.agg(F.min("metric_date"), F.max("metric_date")).first()
    assert span[0] is None or tuple(bounds) == tuple(span)


def test_cancel_day_without_active_subscription_is_not_in_churn(spark):
    subs = staged(spark, ("s", "pro", 79, "cancelled", 0, 2, 4))
    features = spark.createDataFrame([], "feature_id string, is_core_feature boolean, minimum_plan string")
    days = reporting.subscription_days(core.plan_days(subs), core.dim_plans(subs, features))
    churn = reporting.mart_churn(days).collect()
    assert [r.metric_date for r in churn] == [day(0), day(1)]
    assert [r.cancelled_subscriptions for r in churn] == [0, 0]


def test_churn_divides_by_the_same_days_active_count(spark):
    subs = staged(spark, ("s", "pro", 79, "cancelled", 0, 1, 1), ("t", "pro", 79, "active", 0, None, 1),
                  ("u", "pro", 79, "active", 0, None, 1))
    features = spark.createDataFrame([], "feature_id string, is_core_feature boolean, minimum_plan string")
    churn = reporting.mart_churn(reporting.subscription_days(core.plan_days(subs), core.dim_plans(subs, features)))
    assert {r.metric_date: r.daily_churn_rate for r in churn.collect()} == {day(0): 0.0, day(1): 0.5}


def test_plan_with_two_prices_appears_twice(spark):
    subs = staged(spark, ("s", "pro", 79, "active", 0, None, 0), ("t", "pro", 89, "active", 0, None, 0),
                  ("u", "gold", 1, "active", 0, None, 0))
    features = spark.createDataFrame(
        [("f1", True, "starter"), ("f2", False, "pro"), ("f3", False, "business"), ("f4", True, "odd")],
        "feature_id string, is_core_feature boolean, minimum_plan string")
    plans = core.dim_plans(subs, features)
    got = {(r.plan_id, int(r.monthly_price)): (r.available_feature_count, r.available_core_feature_count,
                                               r.plan_tier_rank, int(r.annual_price)) for r in plans.collect()}
    assert got == {("pro", 79): (4, 2, 2, 948), ("pro", 89): (4, 2, 2, 1068), ("gold", 1): (0, 0, None, 12)}
    days = reporting.subscription_days(core.plan_days(subs), plans).collect()
    assert days[0].new_subscriptions == 5  # two pro starts x two prices, one gold start
