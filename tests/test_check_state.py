"""Checks kept as state by batch day against checks of all rows, over changing and broken data."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revlens.operators.exact import exact_avg, exact_sum
from revlens.plans import check_state, quality, sketches
from revlens.plans.models import Now, Workspace
from revlens.session import shared_dir
from revlens.sources.model_store import ModelStore
from revlens.sources.raw_store import RawStore
from revlens.sources.report_store import SCHEMA, ReportStore
from revlens.sources.schemas import RAW_TABLES, raw_schema

NOW = Now(date(2024, 1, 31), datetime(2024, 1, 31, 6))
MODELS = check_state.FACTS["raw_transactions"]


def transactions(spark, *rows):
    """(id, batch day or None, status, method)."""
    names = raw_schema("raw_transactions").names
    full = []
    for tid, day, status, method in rows:
        at = None if day is None else date(2024, 1, day)
        value = dict(transaction_id=tid, user_id="u", transaction_timestamp=datetime(2024, 1, day or 1), batch_date=at,
                     transaction_amount=Decimal(5), transaction_status=status, payment_method=method)
        full.append(tuple(value.get(n) for n in names))
    return spark.createDataFrame(full, raw_schema("raw_transactions"))


def drawn(r, day, prefix=""):
    return [(r.choice([f"{prefix}t{r.randrange(40)}", None]), day, r.choice(["completed", "Failed", "odd", None]),
             r.choice(["card", "shell", None])) for _ in range(12)]


def expected(raw):
    w = Workspace({t: raw.read(t) for t in RAW_TABLES}, NOW)
    parts = [quality.model_report(w, m) for m in MODELS]
    return sorted(tuple(r) for r in parts[0].unionByName(parts[1]).collect())


def reported(store, raw):
    report = check_state.fact_report(store, raw, "raw_transactions")
    return sorted(tuple(r) for r in report.select("model", "column", "rule", "failures").collect())


def test_equals_checks_of_all_rows(spark):
    r, raw, store = random.Random(5), RawStore(spark, shared_dir(spark)), ModelStore(spark, shared_dir(spark))
    raw.replace("raw_transactions", transactions(spark, *(x for d in (1, 2, 3, None) for x in drawn(r, d))))
    assert reported(store, raw) == expected(raw)
    assert reported(store, raw) == expected(raw)  # nothing changed
    for day in (2, 4):
        raw.replace_batch("raw_transactions", transactions(spark, *drawn(r, day)), date(2024, 1, day))
        assert reported(store, raw) == expected(raw)
    raw.replace_batch("raw_transactions", transactions(spark), date(2024, 1, 3))
    assert reported(store, raw) == expected(raw)
    raw.replace("raw_transactions", transactions(spark))
    got = reported(store, raw)
    assert got == expected(raw) and {x[3] for x in got} == {0}


def test_only_changed_days_are_counted_again(spark, monkeypatch):
    r, raw, store = random.Random(6), RawStore(spark, shared_dir(spark)), ModelStore(spark, shared_dir(spark))
    raw.replace("raw_transactions", transactions(spark, *(x for d in (1, 2, 3) for x in drawn(r, d, f"day{d}-"))))
    asked = []
    whole = check_state._repeated
    monkeypatch.setattr(check_state, "_repeated", lambda rows, table, groups: asked.append(groups) or whole(rows, table, groups))
    assert reported(store, raw) == expected(raw)
    raw.replace_batch("raw_transactions", transactions(spark, *drawn(r, 2, "day2-")), date(2024, 1, 2))
    assert reported(store, raw) == expected(raw)
    assert [len(g) for g in asked] == [3, 1] and asked[1] == [["2024-01-02"]]
    files = store.read("checks_raw_transactions").select("batch_date", F.col("_metadata.file_path").alias("f")).distinct()
    loads = {x.batch_date.day: x.f.split("load=")[1].split("/")[0] for x in files.collect()}
    assert loads[1] == loads[3] != loads[2]
    # A key of an earlier day comes again on a new one: their ranges meet, so both are looked at.
    old = raw.read("raw_transactions").where("transaction_id like 'day1%'").first().transaction_id
    raw.replace_batch("raw_transactions", transactions(spark, (old, 4, "completed", "card")), date(2024, 1, 4))
    assert reported(store, raw) == expected(raw)
    assert asked[2] == [["2024-01-01", "2024-01-04"]]


def test_clusters_of_days():
    assert check_state.clusters({}) == []
    zones = {"a": ("1", "3"), "b": ("4", "6"), "c": ("6", "6"), "d": ("0", "0"), "e": ("5", "9"), "f": ("é", "źé")}
    assert check_state.clusters(zones) == [["d"], ["a"], ["b", "c", "e"], ["f"]]


def test_two_runs_write_one_report_a_key(spark):
    path = shared_dir(spark)
    row = lambda n, name: (date(2024, 1, 1), f"m{n}", "revenue", "high", "revenue", name, "e", "r")
    frames = [spark.createDataFrame([row(n, who) for n in range(i, i + 3)], SCHEMA) for i, who in enumerate("abcd")]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda f: ReportStore(spark, path).add(f), frames))
    assert sorted(r.metric_name for r in ReportStore(spark, path).read().collect()) == [f"m{n}" for n in range(6)]
    ReportStore(spark, path).add(spark.createDataFrame([row(9, "x"), row(9, "y")], SCHEMA))
    assert ReportStore(spark, path).read().where("metric_name = 'm9'").count() == 1


def test_exact_sums_do_not_depend_on_order(spark):
    from fractions import Fraction
    r = random.Random(7)
    values = [r.randrange(50) / r.randrange(50, 90) for _ in range(4000)] + [0.0, 1.0, 1 / 3, -0.25, -1 / 7, 4e6]
    results = set()
    for parts in (1, 3, 7):
        r.shuffle(values)
        frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(parts)
        results.add(tuple(frame.agg(exact_sum(F.col("v")), exact_avg(F.col("v"))).first()))
    (total, mean), = results
    exact = sum(map(Fraction, values))
    assert total == pytest.approx(float(exact), rel=2e-16) and mean == pytest.approx(float(exact / len(values)), rel=4e-16)
    assert spark.createDataFrame([(None,)], "v double").agg(exact_avg(F.col("v"))).first()[0] is None


def test_sketches_of_ranges(spark):
    r = random.Random(8)
    rows = [(f"u{r.randrange(3000)}", date(2024, 1, r.randrange(1, 25))) for _ in range(20000)] + [(None, date(2024, 1, 3)), ("u1", None)]
    days = sketches.daily_user_sketches(spark.createDataFrame(rows, "user_id string, metric_date date"))
    for a, b in ((1, 24), (3, 9), (5, 5), (28, 29)):
        start, end = date(2024, 1, a), date(2024, 1, b)
        want = len({u for u, d in rows if u and d and start <= d <= end})
        assert abs(sketches.users_between(days, start, end).first()[0] - want) <= 4 * sketches.ERROR * want
    for x in sketches.rolling_users(days, 7).collect():
        want = len({u for u, d in rows if u and d and 0 <= (x.metric_date - d).days < 7})
        assert abs(x.distinct_users - want) <= 4 * sketches.ERROR * want
    assert sketches.rolling_users(days, 7).count() == days.count()
