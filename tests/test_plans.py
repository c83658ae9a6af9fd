"""Physical plans: what must and must not appear in them."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from revlens.plans.evidence import (PLAN_CONTEXT, SECTIONS, evidence, flagged_anomalies, investigate_all,
                                    report_text)
from revlens.plans.models import BUILT, MODELS, Now, Workspace, inputs_of, with_ancestors
from revlens.session import shared_dir
from revlens.sources.model_store import ModelStore
from revlens.sources.testtables import AS_OF, RUN_TS, raw_tables


@pytest.fixture(scope="module")
def w(spark):
    return Workspace(raw_tables(spark, "/root/testdata/sf0.001"), Now(AS_OF, RUN_TS))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", MODELS)
def test_no_model_multiplies_rows_blindly_or_leaves_the_jvm(w, name):
    text = plan(w[name])
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in text


def test_subscription_days_are_expanded_without_join_or_shuffle(w):
    text = plan(w["fact_subs_by_day"])
    expanded = text[:text.index("Generate explode")]
    assert "Exchange" not in expanded and "Join" not in expanded


def test_day_measures_do_not_expand_subscriptions_before_grouping(w):
    text = plan(w["mart_mrr"])
    assert "Expand" not in text
    assert "subscription_id" not in text[:text.index("partial_sum(active_subscriptions")]


def test_distinct_users_need_no_expand(w):
    for name in ("mart_user_engagement", "mart_plan_performance", "mart_account_health"):
        assert "Expand" not in plan(w[name])


def test_scans_read_only_needed_columns(w):
    text = plan(w["mart_transaction_health"])
    scan = next(x for x in text.splitlines() if "l_extendedprice" in x and "ReadSchema" in x)
    schema = scan[scan.index("ReadSchema"):]
    assert "l_tax" not in schema and "l_shipdate" not in schema


def test_unpivot_computes_the_kpis_once(w):
    assert plan(w["mart_anomaly_candidates"]).count("FileScan") <= plan(w["mart_daily_kpis"]).count("FileScan")


@pytest.fixture(scope="module")
def built(spark):
    workspace = Workspace(raw_tables(spark, "/root/testdata/sf0.001"), Now(AS_OF, RUN_TS))
    workspace.build(ModelStore(spark, shared_dir(spark)))
    return workspace


def test_evidence_never_scans_the_facts(built):
    flagged = flagged_anomalies(built["mart_anomaly_candidates"])
    section = [s for s in SECTIONS["transaction"] if s.name == "failure_breakdown"]
    for text in (plan(evidence(built, section, date(2024, 1, 13))), plan(investigate_all(built, flagged)),
                 plan(report_text(built, flagged))):
        assert "lineitem" not in text and "events.parquet" not in text
    assert PLAN_CONTEXT.key == "plan_id"


def test_a_build_scans_the_transactions_twice(w):
    """Once for the user days, once for the evidence; all else reads these."""
    readers = [n for n in with_ancestors(BUILT) if "fact_transactions" in inputs_of(n)]
    assert readers == ["user_day_transactions", "daily_transaction_mix"]
    assert [n for n in with_ancestors(BUILT) if "fact_product_events" in inputs_of(n)] == ["user_day_usage", "feature_sessions"]


def test_plan_activity_needs_no_expanded_subscriptions(w):
    assert "plan_days" not in inputs_of("plan_day_activity")
    text = plan(w["plan_day_activity"])
    assert "sequence(" not in text and "fact_subs_by_day" not in with_ancestors(["mart_plan_performance"])


def test_invariants_of_the_day_tables(w):
    kpis = w["mart_daily_kpis"]
    span = kpis.agg(F.min("metric_date").alias("a"), F.max("metric_date").alias("b"), F.count(F.lit(1)).alias("n")).first()
    assert (span.b - span.a).days + 1 == span.n
    mrr = w["mart_mrr"]
    assert mrr.where("mrr <> starter_mrr + pro_mrr + business_mrr").count() == 0
    scored = w["mart_anomaly_candidates"]
    assert scored.where("(severity = 'none') <> (previous_value is null)").count() == 0
    assert scored.groupBy("metric_date").count().where("count <> 9").count() == 0
    assert kpis.where("overall_health_score not between 0 and 100").count() == 0
