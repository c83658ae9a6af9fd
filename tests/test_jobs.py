"""Daily and backfill jobs over the smallest tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from revlens.plans import jobs
from revlens.plans.models import Now, Workspace
from revlens.plans.quality import QualityError
from revlens.session import shared_dir
from revlens.sources.model_store import ModelStore
from revlens.sources.raw_store import RawStore, write_raw_csv
from revlens.sources.report_store import ReportStore
from revlens.sources.testtables import AS_OF, RUN_TS, raw_tables

NOW, DAY = Now(AS_OF, RUN_TS), date(2024, 1, 13)


@pytest.fixture(scope="module")
def places(spark):
    root = shared_dir(spark)
    found = jobs.Places(f"{root}/raw", f"{root}/models", f"{root}/reports")
    store = RawStore(spark, found.raw)
    for name, rows in raw_tables(spark, "/root/testdata/sf0.001").items():
        store.replace(name, rows)
    return found


def test_daily_run_reports_once_and_stops_on_a_failed_check(spark, places, tmp_path):
    store, reports = RawStore(spark, places.raw), ReportStore(spark, places.reports)
    before = store.read("raw_transactions").count()
    # from the source: files of the store are replaced by the load
    source = raw_tables(spark, "/root/testdata/sf0.001")["raw_transactions"]
    batch = source.where(F.col("batch_date") == F.lit(DAY))
    write_raw_csv(batch, f"{tmp_path}/good/raw_transactions.csv")
    for _ in range(2):
        jobs.run_daily(spark, places, f"{tmp_path}/good", DAY, NOW)
    assert store.read("raw_transactions").count() == before
    assert [r.metric_date for r in reports.read().collect()] == [DAY]

    write_raw_csv(batch.withColumn("payment_method", F.lit("barter")), f"{tmp_path}/bad/raw_transactions.csv")
    with pytest.raises(QualityError, match="payment_method accepted_values"):
        jobs.run_daily(spark, places, f"{tmp_path}/bad", DAY, NOW)
    assert reports.read().count() == 1


def test_a_daily_run_rewrites_the_days_it_touches_and_equals_a_full_build(spark, tmp_path):
    root = shared_dir(spark)
    own = jobs.Places(f"{root}/raw", f"{root}/models", f"{root}/reports")
    raw = RawStore(spark, own.raw)
    source = raw_tables(spark, "/root/testdata/sf0.001")
    raw.replace_all(source)
    jobs.build_models(spark, own, NOW)

    before, late = files(spark, own, "user_day_transactions"), date(2024, 1, 3)
    batch = source["raw_transactions"].where(F.col("batch_date") == F.lit(DAY))
    moved = batch.withColumn("transaction_timestamp", F.when(
        F.crc32(F.col("transaction_id").cast("binary")) % 4 == 0, F.lit(late).cast("timestamp")
    ).otherwise(F.col("transaction_timestamp")))
    write_raw_csv(moved, f"{tmp_path}/late/raw_transactions.csv")
    w = jobs.run_daily(spark, own, f"{tmp_path}/late", DAY, NOW)
    after = files(spark, own, "user_day_transactions")
    assert {d for d in before if before[d] != after.get(d)} == {DAY, late}
    equals_a_full_build(w, raw)


BY_DAY = ("user_day_transactions", "user_day_usage", "daily_transaction_mix", "feature_sessions", "account_day_activity",
          "plan_day_activity", "mart_user_transaction_activity", "fact_subs_by_day")


def files(spark, places, name):
    """The files that each day of a stored table consists of."""
    rows = ModelStore(spark, places.models).read(name)
    days = {}
    for r in rows.select("metric_date", F.col("_metadata.file_path").alias("f")).distinct().collect():
        days.setdefault(r.metric_date, set()).add(r.f)
    return days


def equals_a_full_build(w, raw):
    full = Workspace(raw.read_all(), NOW)
    for name in (*BY_DAY, "stg_subscriptions", "mart_transaction_health", "mart_plan_performance", "mart_daily_kpis",
                 "mart_anomaly_candidates"):
        a, b = (x[name].drop("created_at") for x in (w, full))
        assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(
            map(repr, b.select(*sorted(b.columns)).collect())), name


def touched(before, after):
    return {d for d in {*before, *after} if before.get(d) != after.get(d)}


def test_changed_subscriptions_and_users_refresh_the_days_they_weigh_on(spark, tmp_path):
    root = shared_dir(spark)
    own = jobs.Places(f"{root}/raw", f"{root}/models", f"{root}/reports")
    raw = RawStore(spark, own.raw)
    source = raw_tables(spark, "/root/testdata/sf0.001")
    raw.replace_all(source)
    first = jobs.build_models(spark, own, NOW)
    start, end = date(2024, 1, 5), date(2024, 1, 9)
    subs = first["stg_subscriptions"]
    last = subs.select(F.max(F.greatest(*[F.to_date(c) for c in ("started_at", "cancelled_at", "updated_at")]))).first()[0]
    # One subscription is made to have lived from the 5th to the 9th.
    victim = subs.where("started_at is not null and cancelled_at is null").orderBy("subscription_id").first()
    stamp = F.lit(last).cast("timestamp")
    mended = source["raw_subscriptions"].where(F.col("subscription_id") == victim.subscription_id).limit(1).withColumns({
        "started_at": F.lit(start).cast("timestamp"), "cancelled_at": F.lit(end).cast("timestamp"), "updated_at": stamp,
        "batch_date": F.lit(DAY), "subscription_status": F.lit("cancelled")})
    daily = source["raw_subscriptions"].where(F.col("batch_date") == F.lit(DAY))
    write_raw_csv(daily.unionByName(mended), f"{tmp_path}/one/raw_subscriptions.csv")
    before = {n: files(spark, own, n) for n in BY_DAY}
    w = jobs.run_daily(spark, own, f"{tmp_path}/one", DAY, NOW)
    equals_a_full_build(w, raw)
    after = {n: files(spark, own, n) for n in BY_DAY}
    old_span = {d for d in before["fact_subs_by_day"] if d >= victim.started_at.date()}
    new_span = {d for d in before["fact_subs_by_day"] if start <= d <= end}
    assert touched(before["fact_subs_by_day"], after["fact_subs_by_day"]) == old_span | new_span
    for name in ("user_day_transactions", "account_day_activity", "mart_user_transaction_activity"):
        assert touched(before[name], after[name]) <= {DAY}, name

    # The same batch again without that row: it is gone from the stored state, too.
    write_raw_csv(daily, f"{tmp_path}/two/raw_subscriptions.csv")
    w = jobs.run_daily(spark, own, f"{tmp_path}/two", DAY, NOW)
    equals_a_full_build(w, raw)
    assert w["stg_subscriptions"].where(F.col("subscription_id") == victim.subscription_id).first() == victim

    # A user's role changes: the days of that user's transactions are made anew, and no others.
    someone = w["mart_user_transaction_activity"].groupBy("user_id").count().orderBy("count", "user_id").first().user_id
    users = source["raw_users"]
    their_days = {r.metric_date for r in w["mart_user_transaction_activity"].where(F.col("user_id") == someone).collect()}
    batch = users.where(F.col("user_id") == someone).first().batch_date
    write_raw_csv(users.where(F.col("batch_date") == F.lit(batch)).withColumn("role", F.when(
        F.col("user_id") == someone, F.when(F.lower("role") == "owner", "admin").otherwise("owner")).otherwise(F.col("role"))), f"{tmp_path}/three/raw_users.csv")
    before = files(spark, own, "mart_user_transaction_activity")
    w = jobs.run_daily(spark, own, f"{tmp_path}/three", batch, NOW)
    equals_a_full_build(w, raw)
    own_batch = {d for d in before if d == batch}
    changed = touched(before, files(spark, own, "mart_user_transaction_activity"))
    assert their_days <= changed <= their_days | own_batch | {
        r.metric_date for r in w["user_day_transactions"].select("metric_date").distinct().collect()
        if r.metric_date in jobs._batch_days(raw, batch)["fact_transactions"]}


def test_every_flagged_move_gets_one_report(spark, places):
    raw = raw_tables(spark, "/root/testdata/sf0.001")
    w = Workspace(raw, NOW)
    w.build(ModelStore(spark, shared_dir(spark)))
    own = jobs.Places(places.raw, places.models, shared_dir(spark))
    for _ in range(2):
        jobs.investigate_every(spark, own, w)
    flagged = w["mart_anomaly_candidates"].where("should_investigate").count()
    reports = ReportStore(spark, own.reports).read()
    assert reports.count() == flagged > 0
    assert reports.where("summary is null or evidence is null or report is null").count() == 0


def test_quiet_day_writes_no_report(spark, places):
    w = Workspace(raw_tables(spark, "/root/testdata/sf0.001"), NOW)
    w.build(ModelStore(spark, shared_dir(spark)))
    own = jobs.Places(places.raw, places.models, shared_dir(spark))
    jobs.investigate(spark, own, w, date(2030, 1, 1))
    assert ReportStore(spark, own.reports).read().count() == 0
