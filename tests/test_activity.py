"""Activity models on literal and random rows, the random ones against pandas."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revlens.plans import core, reporting
from revlens.plans.models import Now, Workspace
from revlens.sources.schemas import RAW_TABLES, raw_schema

DAY0 = date(2024, 1, 1)
NOW = Now(date(2024, 1, 31), datetime(2024, 1, 31, 6))


def at(n):
    return datetime(2024, 1, 1) + timedelta(days=n)


def table(spark, name, rows):
    names = raw_schema(name).names
    return spark.createDataFrame([tuple({**dict.fromkeys(names), **r}[n] for n in names) for r in rows],
                                 raw_schema(name))


def workspace(spark, **rows):
    return Workspace({t: table(spark, t, rows.get(t, [])) for t in RAW_TABLES}, NOW)


def user(uid, account, **more):
    return dict(user_id=uid, account_id=account, role="owner", user_status="active",
                onboarding_completed=True, created_at=at(0), **more)


def sub(sid, account, plan, start=0, **more):
    price = {"starter": 29, "pro": 79, "business": 199}[plan]
    return dict(subscription_id=sid, account_id=account, plan_id=plan, monthly_price=Decimal(price),
                subscription_status="active", started_at=at(start), updated_at=at(3), batch_date=DAY0, **more)


def tx(tid, uid, n=0, status="completed", amount="10.00"):
    return dict(transaction_id=tid, user_id=uid, transaction_timestamp=at(n), transaction_status=status,
                transaction_amount=Decimal(amount))


def event(eid, uid, feature, n=0, status="success", device="desktop", session="s"):
    return dict(event_id=eid, user_id=uid, feature_id=feature, event_timestamp=at(n), event_status=status,
                device_type=device, session_id=session)


FEATURES = [dict(feature_id=f"f{i}", feature_name=f"n{i}", feature_category="core", minimum_plan="starter",
                 is_core_feature=True) for i in (1, 2)]


def test_fan_out_multiplies_rows_but_not_users(spark):
    w = workspace(spark, raw_users=[user("u", "a"), user("v", "b")],
                  raw_subscriptions=[sub("1", "a", "pro"), sub("2", "a", "pro"), sub("3", "a", "business")],
                  raw_transactions=[tx("t1", "u"), tx("t2", "u", status="failed"), tx("t3", "v")],
                  raw_product_events=[event("e1", "u", "f1"), event("e2", "u", "f1", status="failed")],
                  raw_features=FEATURES)
    rows = {(r.plan_id): r for r in w["mart_plan_performance"].where(F.col("metric_date") == DAY0).collect()}
    pro, business = rows["pro"], rows["business"]
    assert (pro.total_transactions, business.total_transactions) == (4, 2)
    assert (pro.completed_transaction_volume, business.completed_transaction_volume) == (20, 10)
    assert (pro.total_product_events, pro.active_users, pro.events_per_active_user) == (4, 1, 4.0)
    assert pro.transaction_failure_rate == pro.event_failure_rate == 0.5
    # v's account has no subscription: in the health totals, in no plan
    health = w["mart_transaction_health"].first()
    assert health.total_transactions == 3 and health.completed_transaction_volume == 20


def test_zero_denominators_and_null_volume(spark):
    w = workspace(spark, raw_users=[user("u", "a")],
                  raw_subscriptions=[sub("1", "a", "pro", start=2)],
                  raw_transactions=[tx("t1", "u", status="failed")],
                  raw_product_events=[event("e1", "u", "f1")], raw_features=FEATURES, raw_accounts=[
                      dict(account_id="a", account_status="active"), dict(account_id="b", account_status="churned"),
                      dict(account_id="c")])
    plan = w["mart_plan_performance"].where(F.col("metric_date") == DAY0).first()
    assert plan.churn_rate is None and plan.avg_revenue_per_subscription is None and plan.mrr == 0
    assert w["mart_transaction_health"].first().completed_transaction_volume is None
    kpis = w["mart_daily_kpis"].orderBy("metric_date").collect()
    assert kpis[0].completed_transaction_volume == 0 and kpis[0].churn_rate == 0.0
    assert [r.metric_date for r in kpis] == [DAY0 + timedelta(days=i) for i in range(4)]
    health = {r.account_id: r for r in w["mart_account_health"].collect()}
    assert health["c"].transaction_failure_rate_30d is None and health["c"].is_at_risk is False
    assert health["a"].transaction_failure_rate_30d == 1.0 and health["a"].is_at_risk is False
    assert health["b"].is_at_risk is True and health["a"].as_of_date == DAY0 + timedelta(days=3)


def test_paying_account_without_recent_activity_is_at_risk(spark):
    w = workspace(spark, raw_accounts=[dict(account_id="a", account_status="active")],
                  raw_subscriptions=[sub("1", "a", "pro")], raw_users=[user("u", "a")])
    row = w["mart_account_health"].first()
    assert row.is_at_risk is True and row.current_mrr == 79


def test_unknown_feature_counts_in_engagement_only(spark):
    w = workspace(spark, raw_users=[user("u", "a")], raw_features=FEATURES,
                  raw_product_events=[event("e1", "u", "f1"), event("e2", "u", "zzz", n=2), event("e3", "u", "f2")])
    engagement = {r.metric_date: r for r in w["mart_user_engagement"].collect()}
    assert [engagement[DAY0 + timedelta(days=i)].total_events for i in range(3)] == [2, 0, 1]
    assert engagement[DAY0].core_events == 2 and engagement[DAY0 + timedelta(days=2)].core_events == 0
    adoption = w["mart_feature_adoption"]
    assert adoption.count() == 6 and adoption.agg(F.sum("total_feature_events")).first()[0] == 2
    # one user of two features counts twice per day
    daily = reporting.daily_features(adoption).where(F.col("metric_date") == DAY0).first()
    assert daily.active_feature_users == 2 and daily.feature_adoption_rate == 1.0


def test_unknown_values_are_false_not_null(spark):
    w = workspace(spark, raw_transactions=[tx("t", "u", status=None)], raw_product_events=[
        event("e", "u", "f1", status=None)], raw_users=[dict(user_id="u")], raw_accounts=[dict(account_id="a")],
        raw_features=[dict(feature_id="f")])
    for name in ("fact_transactions", "fact_product_events", "dim_users", "dim_accounts", "dim_features"):
        row = w[name].first().asDict()
        flags = {k: v for k, v in row.items() if k.startswith("is_") and k != "is_core_feature"}
        assert flags and set(flags.values()) == {False}, name
    assert w["dim_features"].first().adoption_segment == "hard_adoption"
    assert w["dim_users"].first().onboarding_segment == "not_completed_onboarding"


@pytest.mark.parametrize("seed", [1, 2])
def test_skewed_activity_against_pandas(spark, seed):
    """One user has a third of all rows, one account most subscriptions."""
    rng = random.Random(seed)
    users = [user(f"u{i}", f"a{i % 4}") for i in range(9)]
    subs = [sub(f"s{i}", "a0" if i < 6 else f"a{i % 5}", rng.choice(list(core.PLANS)), start=rng.randrange(3))
            for i in range(10)]
    pick = lambda: "u0" if rng.random() < 1 / 3 else f"u{rng.randrange(11)}"  # noqa: E731  u9, u10 are unknown
    txs = [tx(f"t{i}", pick(), rng.randrange(5), rng.choice(["completed", "failed", "pending"]), f"{i}.25")
           for i in range(300)]
    events = [event(f"e{i}", pick(), f"f{rng.randrange(1, 4)}", rng.randrange(5), rng.choice(["success", "failed"]),
                    rng.choice(["mobile", "desktop"]), f"s{rng.randrange(40)}") for i in range(300)]
    w = workspace(spark, raw_users=users, raw_subscriptions=subs, raw_transactions=txs, raw_product_events=events,
                  raw_features=FEATURES)
    facts = w["fact_subs_by_day"].where("is_active_subscription").toPandas()
    people = pd.DataFrame(users)
    t = pd.DataFrame(txs).assign(metric_date=lambda d: d.transaction_timestamp.dt.date)
    e = pd.DataFrame(events).assign(metric_date=lambda d: d.event_timestamp.dt.date)
    held = people.merge(facts[["account_id", "metric_date", "plan_id"]], on="account_id")
    tx_rows = t.merge(held, on=["user_id", "metric_date"])
    ev_rows = e.merge(held, on=["user_id", "metric_date"])
    for row in w["mart_plan_performance"].collect():
        a = tx_rows[(tx_rows.metric_date == row.metric_date) & (tx_rows.plan_id == row.plan_id)]
        b = ev_rows[(ev_rows.metric_date == row.metric_date) & (ev_rows.plan_id == row.plan_id)]
        assert row.total_transactions == len(a)
        assert row.failed_transactions == (a.transaction_status == "failed").sum()
        assert row.completed_transaction_volume == sum(a.transaction_amount[a.transaction_status == "completed"], Decimal(0))
        assert (row.total_product_events, row.active_users) == (len(b), b.user_id.nunique())
    for row in w["mart_user_engagement"].collect():
        day = e[e.metric_date == row.metric_date]
        assert (row.total_events, row.daily_active_users) == (len(day), day.user_id.nunique())
        assert row.active_mobile_users == day[day.device_type == "mobile"].user_id.nunique()
        assert row.onboarded_active_users == day[day.user_id.isin(people.user_id)].user_id.nunique()
    for row in w["mart_feature_adoption"].collect():
        used = e[(e.metric_date == row.metric_date) & (e.feature_id == row.feature_id)]
        assert (row.total_feature_events, row.active_feature_users, row.feature_sessions) == (
            len(used), used.user_id.nunique(), used.session_id.nunique())


def test_empty_tables_build_empty_models(spark):
    w = workspace(spark)
    for name in ("mart_mrr", "mart_churn", "mart_user_engagement", "mart_feature_adoption", "mart_plan_performance",
                 "mart_account_health", "mart_daily_kpis", "mart_anomaly_candidates"):
        assert w[name].count() == 0, name
