from collections import Counter

import pytest
from pyspark.sql import functions as F

from revlens.plans import quality
from revlens.plans.models import BUILT, FUNCTIONS, MODELS, inputs_of, waves, with_ancestors
from revlens.session import local_session  # noqa: F401
from revlens.sources.testtables import AS_OF, RUN_TS, raw_tables


def rows(df):
    return {(r["column"], r["rule"]): r["failures"] for r in df.collect()}


def test_null_fails_only_not_null(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("x",), ("x",)], "v string")
    assert rows(quality.column_failures(df, ["v"], {"v": ["a"]})) == {("v", "not_null"): 2, ("v", "accepted_values"): 2}
    assert rows(quality.unique_failures(df, "v")) == {("v", "unique"): 1}
    parent = spark.createDataFrame([("a",)], "k string")
    assert rows(quality.relationship_failures(df, "v", parent, "k")) == {("v", "relationships"): 2}
    assert quality.orphan_rows(df, "v", parent, "k").count() == 2


def test_checks_of_an_empty_table_pass(spark):
    df = spark.createDataFrame([], "v string")
    assert set(rows(quality.column_failures(df, ["v"], {"v": ["a"]})).values()) == {0}
    assert rows(quality.unique_failures(df, "v")) == {("v", "unique"): 0}
    assert rows(quality.relationship_failures(df, "v", df, "v")) == {("v", "relationships"): 0}


def test_declared_suite_is_complete(spark):
    from revlens.plans.models import BUILT, Now, Workspace
    w = Workspace(raw_tables(spark, "/root/testdata/sf0.001"), Now(AS_OF, RUN_TS))
    count = Counter()
    for name, checks in quality.SUITE.items():
        columns = w[name].columns
        count["not_null"] += len(checks.not_null_columns(columns))
        count["unique"] += checks.unique is not None
        count["accepted_values"] += len(checks.accepted.split())
        count["relationships"] += len(checks.parents)
        assert set(checks.not_null_columns(columns)) | set(checks.accepted.split()) <= set(columns)
    assert count == {"not_null": 147, "unique": 18, "accepted_values": 45, "relationships": 2}


def test_gate_stops_and_names_the_failure(spark):
    good = spark.createDataFrame([("m", "c", "not_null", 0)], "model string, column string, rule string, failures long")
    quality.quality_gate(good)
    with pytest.raises(quality.QualityError, match="m.c not_null: 3"):
        quality.quality_gate(good.withColumn("failures", F.lit(3)))


def test_model_order():
    assert len(MODELS) == 23
    order = with_ancestors(BUILT)
    assert set(order) == set(FUNCTIONS)
    for name in order:
        assert all(order.index(p) < order.index(name) for p in inputs_of(name) if p in FUNCTIONS)
    for wave in waves(order):
        assert not any(p in wave for n in wave for p in inputs_of(n))
    subset = with_ancestors(["mart_transaction_health"])
    assert subset == ["stg_transactions", "fact_transactions", "user_day_transactions", "mart_transaction_health"]
