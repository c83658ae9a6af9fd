from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revlens.plans import evidence
from revlens.plans.anomaly import EXACT, METRICS, metric_config, score_series


def score(spark, metric, *values):
    rows = [(date(2024, 1, 1 + i), metric, None if v is None else Decimal(v)) for i, v in enumerate(values)]
    series = spark.createDataFrame(rows, f"metric_date date, metric_name string, current_value {EXACT}")
    return score_series(series, metric_config(spark)).orderBy("metric_date").collect()


@pytest.mark.parametrize("metric, before, now, severity, flagged, direction", [
    ("mrr", "100", "110", "medium", False, "up"),          # exactly the threshold: medium, not flagged
    ("mrr", "100", "115", "high", True, "up"),
    ("mrr", "100", "120", "critical", True, "up"),
    ("mrr", "100", "109.99", "low", False, "up"),
    ("mrr", "0", "500", "low", False, "up"),               # no base to compare with
    ("mrr", "100", "100", "low", False, "flat"),
    ("event_failure_rate", "0.15", "0.10", "medium", False, "down"),  # exactly 0.05
    ("event_failure_rate", "0.10", "0.175", "high", True, "up"),
    ("churn_rate", "0.05", "0.01", "critical", True, "down"),         # an improvement is flagged, too
    ("cancelled_subscriptions", "0", "6", "critical", True, "up"),    # absolute rule works from zero
    ("daily_active_users", "100", "151", "medium", True, "up"),
])
def test_scorer_edges(spark, metric, before, now, severity, flagged, direction):
    first, second = score(spark, metric, before, now)
    assert (first.severity, first.should_investigate, first.anomaly_direction) == ("none", False, "flat")
    assert (second.severity, second.should_investigate, second.anomaly_direction) == (severity, flagged, direction)


@pytest.mark.parametrize("before, now, severity, direction, change, percent", [
    ((7, 52), (1, 45), "critical", "down", -0.1124, -0.8349),
    ((1, 26), (5, 54), "medium", "up", 0.0541, 1.4074),
])
def test_published_moves(spark, before, now, severity, direction, change, percent):
    row = score(spark, "transaction_failure_rate", *[str(round(a / b, 12)) for a, b in (before, now)])[1]
    assert (row.severity, row.anomaly_direction, row.should_investigate) == (severity, direction, True)
    assert round(row.absolute_change, 4) == change and round(row.percent_change, 4) == percent


def test_percent_change_is_null_without_base(spark):
    assert score(spark, "mrr", "0", "5")[1].percent_change is None


def test_series_are_scored_independently(spark):
    a = score(spark, "mrr", "1", "2")
    rows = [(date(2024, 1, d), m[0], Decimal(d)) for d in (1, 2, 3) for m in METRICS]
    series = spark.createDataFrame(rows, f"metric_date date, metric_name string, current_value {EXACT}")
    scored = score_series(series, metric_config(spark))
    assert scored.count() == 27 and scored.where("severity = 'none'").count() == 9
    assert a[1].previous_value == 1.0


def candidates(spark, *rows):
    return spark.createDataFrame(
        list(rows), "metric_date date, metric_name string, metric_category string, severity string, "
                    "should_investigate boolean")


def test_top_anomaly_order_and_absence(spark):
    d1, d2 = date(2024, 1, 1), date(2024, 1, 2)
    rows = candidates(spark, (d1, "b", "revenue", "critical", True), (d2, "c", "revenue", "critical", True),
                      (d2, "a", "revenue", "critical", True), (d2, "z", "revenue", "high", True),
                      (d2, "y", "revenue", "critical", False))
    assert [r.metric_name for r in evidence.top_anomaly(rows).collect()] == ["a"]
    assert [r.metric_name for r in evidence.top_anomaly(rows, d1).collect()] == ["b"]
    assert evidence.top_anomaly(rows, date(2024, 2, 1)).count() == 0


def test_classification(spark):
    kinds = [("reliability", "event_failure_rate", "engagement"), ("reliability", "transaction_failure_rate", "transaction"),
             ("revenue", "mrr", "revenue"), ("retention", "churn_rate", "churn"),
             ("engagement", "daily_active_users", "engagement"), ("other", "x", "revenue"), (None, None, "revenue")]
    df = spark.createDataFrame(kinds, "category string, metric string, want string")
    got = df.select("want", evidence.classify_anomaly(F.col("category"), F.col("metric")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
