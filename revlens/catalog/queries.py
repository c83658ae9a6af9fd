"""Registered queries: one per operator or model, over the whole test tables.

Every query is ``(spark, folder) -> DataFrame``. Lazy models are composed from
the raw tables; queries about stored tables (evidence, checks, jobs) build the
models into the shared folder first, once per session and data folder.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import columns as X
from revlens.operators import ids, topk
from revlens.operators.calendar import all_bounds, day_bounds, each_day, fill_days, on_every_day
from revlens.operators.carry import lag_with_carry
from revlens.operators.latest import latest_per_key
from revlens.plans import anomaly, check_state, core, evidence, jobs, quality, reporting, serving, sketches, staging
from revlens.plans.models import MODELS, Now, Workspace
from revlens.session import prepare, shared_dir
from revlens.sources.model_store import ModelStore
from revlens.sources.raw_store import BatchError, RawStore, read_raw_csv, write_batch_once, write_raw_csv
from revlens.sources.report_store import ReportStore
from revlens.sources.schemas import DAILY_TABLES, RAW_TABLES
from revlens.sources.testtables import AS_OF, RUN_TS, raw_tables

Query = Callable[[SparkSession, str], DataFrame]

DAY = date(2024, 1, 13)         # the day single-day evidence is asked for
BATCH = date(2024, 1, 10)       # the day that is loaded again
NOW = Now(AS_OF, RUN_TS)

QUERIES: dict[str, Query] = {}
_built: dict[tuple[str, str], Workspace] = {}


def lazy(spark: SparkSession, folder: str) -> Workspace:
    return Workspace(raw_tables(prepare(spark), folder), NOW)


def built(spark: SparkSession, folder: str) -> Workspace:
    """All models as stored tables."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _built:
        workspace = lazy(spark, folder)
        workspace.build(ModelStore(spark, shared_dir(spark)))
        _built[key] = workspace
    return _built[key]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, after all sums were exact."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema])


def _register(make: Callable[[SparkSession, str], Workspace]):
    def register(function: Callable[[Workspace], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(function(make(spark, folder)))
        run.__name__ = function.__name__
        QUERIES[function.__name__] = run
        return function
    return register


on_lazy, on_built = _register(lazy), _register(built)


def on_session(function: Query) -> Query:
    QUERIES[function.__name__] = lambda spark, folder: plain(function(prepare(spark), folder))
    return function


# --- models -------------------------------------------------------------------

def _model(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(lazy(spark, folder)[name].drop("created_at") if name == "mart_anomaly_candidates"
                     else lazy(spark, folder)[name])
    return run


for _name in MODELS:
    QUERIES[_name] = _model(_name)


@on_lazy
def mart_mrr_from_days(w):
    """MRR grouped from the expanded fact; must equal the change-based model."""
    price = F.col("normalized_monthly_price")
    return w["fact_subs_by_day"].where("is_active_subscription").groupBy("metric_date").agg(
        F.count_distinct("subscription_id").alias("active_subscriptions"), F.sum(price).alias("mrr"))


# --- sources and sinks ----------------------------------------------------------

@on_session
def scan_raw_csv(spark, folder):
    path = shared_dir(spark)
    rows = raw_tables(spark, folder)["raw_subscriptions"]
    write_raw_csv(rows.select(*reversed(rows.columns)), path)  # columns are found by name
    return read_raw_csv(spark, path, "raw_subscriptions")


@on_session
def scan_raw_table(spark, folder):
    store = RawStore(spark, shared_dir(spark))
    store.replace("raw_product_events", raw_tables(spark, folder)["raw_product_events"])
    return store.read("raw_product_events")


@on_session
def load_append(spark, folder):
    store, users = RawStore(spark, shared_dir(spark)), raw_tables(spark, folder)["raw_users"]
    early = F.col("batch_date") < F.lit(BATCH)
    store.append("raw_users", users.where(early))
    store.append("raw_users", users.where(~early))
    return store.read("raw_users")


@on_session
def load_replace(spark, folder):
    store, users = RawStore(spark, shared_dir(spark)), raw_tables(spark, folder)["raw_users"]
    store.replace("raw_users", users.withColumn("role", F.lit("none")))
    store.replace("raw_users", users)
    return store.read("raw_users")


@on_session
def load_daily_batch(spark, folder):
    """One day is loaded again, twice, with corrected amounts."""
    store, rows = RawStore(spark, shared_dir(spark)), raw_tables(spark, folder)["raw_transactions"]
    store.replace("raw_transactions", rows)
    again = rows.where(F.col("batch_date") == F.lit(BATCH)).withColumn(
        "transaction_amount", (F.col("transaction_amount") + 1).cast("decimal(18,2)"))
    batches = shared_dir(spark)
    write_raw_csv(again, f"{batches}/raw_transactions.csv")
    for _ in range(2):
        store.load_daily(batches, BATCH)
    return store.read("raw_transactions")


def _failing(load: Callable[[], object]) -> None:
    try:
        load()
    except BatchError:
        return
    raise AssertionError("a batch with broken values was loaded")


@on_session
def load_stopped(spark, folder):
    """A daily batch and a backfill with a broken amount each stop, and the table is what it was."""
    store, rows = RawStore(spark, shared_dir(spark)), raw_tables(spark, folder)["raw_transactions"]
    store.replace("raw_transactions", rows)
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]).withColumn(
        "transaction_amount", F.when(F.lower("transaction_status") == "failed", "n/a").otherwise(F.col("transaction_amount")))
    daily, backfill = shared_dir(spark), shared_dir(spark)
    write_raw_csv(text.where(F.col("batch_date") == F.lit(BATCH).cast("string")), f"{daily}/raw_transactions.csv")
    write_raw_csv(text, f"{backfill}/raw_transactions.csv")
    _failing(lambda: store.load_daily(daily, BATCH))
    _failing(lambda: store.load_backfill(backfill))
    return store.read("raw_transactions").groupBy("batch_date").agg(
        F.count(F.lit(1)).alias("transactions"), F.count("transaction_amount").alias("amounts"),
        F.sum("transaction_amount").alias("volume"))


@on_session
def load_with_rejects(spark, folder):
    """Below the bound, rows with broken values are set aside with their reasons and the others load."""
    store, rows = RawStore(spark, shared_dir(spark), max_reject_share=0.9), raw_tables(spark, folder)["raw_transactions"]
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]).withColumns({
        "transaction_amount": F.when(F.lower("transaction_status") == "failed", "n/a").otherwise(F.col("transaction_amount")),
        "batch_date": F.when(F.lower("transaction_status") == "refunded", "someday").otherwise(F.col("batch_date"))})
    path = shared_dir(spark)
    write_raw_csv(text, f"{path}/raw_transactions.csv")
    store.load_backfill(path)
    rejected = store.rejects("raw_transactions")
    first = F.split("record", ",")[0]
    return rejected.select(first.alias("transaction_id"), "reason").unionByName(
        store.read("raw_transactions").select("transaction_id", F.lit("loaded").alias("reason")))


@on_session
def write_batch_once_(spark, folder):
    path, accounts = shared_dir(spark), raw_tables(spark, folder)["raw_accounts"]
    write_batch_once(accounts, path)
    write_batch_once(accounts.withColumn("region", F.lit("none")), path)
    return read_raw_csv(spark, path, "raw_accounts")


QUERIES["write_batch_once"] = QUERIES.pop("write_batch_once_")


@on_session
def read_state(spark, folder):
    store = RawStore(spark, shared_dir(spark))
    store.replace("raw_users", raw_tables(spark, folder)["raw_users"])
    return store.keys("raw_users", "user_id", "account_id")


@on_session
def materialize_view(spark, folder):
    w = lazy(spark, folder)
    ModelStore(spark, shared_dir(spark)).view("stg_users", w["stg_users"])
    return spark.table("stg_users")


@on_session
def materialize_table(spark, folder):
    w = lazy(spark, folder)
    return ModelStore(spark, shared_dir(spark)).table(
        "fact_transactions", w["fact_transactions"], "transaction_date")


@on_session
def param_query(spark, folder):
    w = lazy(spark, folder)
    return spark.sql(
        "select transaction_id, user_id, transaction_amount from {t} "
        "where transaction_date = :day and transaction_status = :status",
        args={"day": DAY, "status": "failed"}, t=w["fact_transactions"])


@on_session
def assign_entity_ids(spark, folder):
    """New users for all orders, numbered after the existing users."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey")
    return ids.assign_entity_ids(orders, "o_orderkey", lazy(spark, folder)["raw_users"], "user_id", "usr_")


@on_session
def assign_daily_ids(spark, folder):
    events = lazy(spark, folder)["fact_product_events"].select(F.col("event_id").alias("source_id"), "event_date")
    return ids.assign_daily_ids(events, "source_id", "event_date", "event_id", "evt_")


@on_lazy
def records_json(w):
    failures = evidence.daily_failures(w["daily_transaction_mix"])
    order = [F.desc("failed_count"), F.col("metric_date"), F.col("payment_method"), F.col("failure_reason")]
    return topk.records_json(failures, order)


@on_built
def report_sink(w):
    """Half of the reports are stored first; storing all then adds the rest only."""
    spark = w["mart_mrr"].sparkSession
    store = ReportStore(spark, shared_dir(spark))
    reports = evidence.report_text(w, evidence.flagged_anomalies(w["mart_anomaly_candidates"]))
    store.add(reports.where(F.col("metric_date") < F.lit(BATCH)))
    store.add(reports)
    return store.read(start=date(2023, 12, 10), end=date(2024, 1, 20)) \
        .select("metric_date", "metric_name", "severity", "summary")


# --- projections and filters ------------------------------------------------------

@on_lazy
def project_rename_cast(w):
    raw = w["raw_transactions"]
    return staging.stg_transactions(raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns]))


@on_lazy
def normalize_case(w):
    return w["raw_accounts"].groupBy(
        F.lower("industry").alias("industry"), F.lower("acquisition_channel").alias("acquisition_channel"),
        F.upper("region").alias("region")).agg(F.count(F.lit(1)).alias("accounts"))


@on_lazy
def flag_columns(w):
    return w["fact_transactions"].select(
        "transaction_id", *[f"is_{s}_transaction" for s in ("completed", "failed", "refunded", "pending")])


@on_lazy
def indicator_counts(w):
    return w["fact_transactions"].groupBy("transaction_date").agg(*[
        F.sum(c).alias(c) for c in ("completed_transaction_count", "failed_transaction_count",
                                    "refunded_transaction_count", "completed_transaction_amount")])


@on_lazy
def rank_map(w):
    return w["stg_accounts"].select(
        "account_id", X.rank_in(F.col("company_size"), core.COMPANY_SIZES).alias("size_rank"),
        X.rank_in(F.col("industry"), ("cleaning", "wellness")).alias("partial_rank"))


@on_lazy
def display_name(w):
    return w["dim_accounts"].groupBy("industry_display_name", "company_size_display_name",
                                     "acquisition_channel_display_name").agg(F.count(F.lit(1)).alias("accounts"))


@on_lazy
def segment_map(w):
    events = w["fact_product_events"].join(w["dim_features"].select("feature_id", "adoption_segment"), "feature_id")
    return events.groupBy("adoption_segment").agg(F.count(F.lit(1)).alias("events"))


@on_lazy
def filter_equality(w):
    return w["fact_subs_by_day"].where("is_active_subscription = true").select("metric_date", "subscription_id")


@on_lazy
def filter_null(w):
    return w["fact_subs_by_day"].where("cancelled_at is not null").select("metric_date", "subscription_id")


@on_lazy
def filter_in(w):
    return w["stg_subscriptions"].where(F.col("subscription_status").isin(*core.PAYING_STATUSES)) \
        .select("subscription_id", "subscription_status")


@on_lazy
def filter_between(w):
    return w["mart_transaction_health"].where(
        F.col("metric_date").between(F.date_sub(F.lit(DAY), evidence.TREND_DAYS), F.lit(DAY)))


@on_lazy
def filter_trailing_window(w):
    as_of = core.subscription_bounds(w["stg_subscriptions"]).select("last").scalar()
    inside = (F.col("transaction_date") > F.date_sub(as_of, 30)) & (F.col("transaction_date") <= as_of)
    return w["fact_transactions"].where(inside).select("transaction_id", "transaction_date")


@on_lazy
def filter_recent(w):
    recent = F.col("last_login_at") >= F.date_sub(F.lit(AS_OF), 30)
    return w["stg_users"].where(recent).select("user_id", "last_login_at")


@on_lazy
def filter_rownum(w):
    newest = Window.partitionBy("account_id").orderBy(F.desc("created_at"), "user_id")
    return w["stg_users"].select("account_id", "user_id", F.row_number().over(newest).alias("row_num")) \
        .where("row_num = 1")


# --- joins ------------------------------------------------------------------------

@on_lazy
def join_inner(w):
    return w["fact_product_events"].join(w["dim_features"], "feature_id").select(
        "event_id", "feature_id", "feature_category")


@on_lazy
def join_inner_composite(w):
    return w["plan_day_activity"].select(
        "metric_date", "plan_id", "total_transactions", "failed_transactions", "events", "active_users")


@on_lazy
def join_left(w):
    users = w["dim_users"].where("is_active_user").select("user_id", "role")
    return w["user_day_usage"].join(users, "user_id", "left").select(
        "user_id", "metric_date", "feature_id", "role", "events")


@on_lazy
def join_left_composite(w):
    calendar = on_every_day(w["dim_features"].select("feature_id"), day_bounds(w["fact_product_events"], "event_date"))
    return calendar.join(w["feature_sessions"], ["metric_date", "feature_id"], "left") \
        .select("metric_date", "feature_id", "feature_sessions")


@on_lazy
def join_left_then_not_null(w):
    return w["user_day_transactions"].join(w["dim_users"], "user_id").groupBy("role").agg(
        F.count(F.lit(1)).alias("user_days"), F.sum("total_transactions").alias("transactions"))


@on_lazy
def join_cross_calendar(w):
    covered = all_bounds(day_bounds(w["fact_transactions"], "transaction_date"),
                         day_bounds(w["fact_product_events"], "event_date"))
    return on_every_day(w["dim_plans"].select("plan_id"), covered)


@on_lazy
def join_cross_scalar(w):
    as_of = core.subscription_bounds(w["stg_subscriptions"]).select("last").scalar()
    return w["dim_accounts"].select("account_id", as_of.alias("as_of_date"))


@on_lazy
def join_interval(w):
    return w["fact_subs_by_day"].select("metric_date", "subscription_id", "plan_id")


@on_lazy
def join_theta_or(w):
    return w["dim_plans"].select("plan_id", "available_feature_count", "available_core_feature_count")


@on_lazy
def scalar_subquery(w):
    covered = all_bounds(core.subscription_bounds(w["stg_subscriptions"]),
                         day_bounds(w["fact_transactions"], "transaction_date"),
                         day_bounds(w["fact_product_events"], "event_date"))
    return w["dim_plans"].select("plan_id", covered.select("first").scalar().alias("start_date"),
                                 covered.select("last").scalar().alias("end_date"))


@on_lazy
def join_anti_orphans(w):
    return quality.orphan_rows(w["stg_users"], "user_id", w["stg_product_events"], "user_id") \
        .select("user_id", "account_id")


# --- aggregations --------------------------------------------------------------------

@on_lazy
def agg_count(w):
    return w["fact_transactions"].groupBy("transaction_status").agg(
        F.count(F.lit(1)).alias("all_rows"), F.count("failure_reason").alias("with_reason"))


@on_lazy
def agg_count_distinct(w):
    return w["fact_product_events"].groupBy("event_date").agg(
        F.count_distinct("user_id").alias("users"))


@on_lazy
def agg_count_distinct_case(w):
    """Three distinct counts of one key: reduce to (day, user) with marks, then count."""
    device = F.col("device_type")
    per_user = w["fact_product_events"].groupBy("event_date", "user_id").agg(
        F.bool_or(device == "mobile").alias("mobile"), F.bool_or(device == "desktop").alias("desktop"))
    return per_user.groupBy("event_date").agg(
        F.count("user_id").alias("users"), F.count_if("mobile").alias("mobile_users"),
        F.count_if("desktop").alias("desktop_users"))


@on_lazy
def agg_filter_count(w):
    return w["fact_product_events"].groupBy("event_date", "feature_id").agg(*[
        F.count_if(F.col("device_type") == d).alias(f"{d}_events") for d in ("desktop", "mobile", "tablet")])


@on_lazy
def agg_filter_distinct(w):
    """Distinct subscriptions per plan and day: they are rows of the plan's daily state."""
    return w["plan_days"].select(
        "metric_date", "plan_id", "active_subscriptions", "new_subscriptions", "cancelled_subscriptions") \
        .where("active_subscriptions > 0 or new_subscriptions > 0 or cancelled_subscriptions > 0")


@on_lazy
def agg_filter_sum(w):
    return w["fact_transactions"].groupBy("user_id").agg(
        X.sum_where(F.col("is_refunded_transaction"), F.col("transaction_amount")).alias("refunded_amount"))


@on_lazy
def agg_sum_case_pivot(w):
    return w["mart_mrr"].select("metric_date", "starter_mrr", "pro_mrr", "business_mrr")


@on_lazy
def agg_pivot_of_agg(w):
    per_plan = w["plan_days"].groupBy("metric_date", "plan_id").agg(F.sum("mrr").alias("mrr"))
    return per_plan.groupBy("metric_date").agg(*[
        X.zero(X.sum_where(F.col("plan_id") == p, F.col("mrr"))).alias(p) for p in core.PLANS])


@on_lazy
def agg_ratio(w):
    return w["fact_transactions"].groupBy("payment_method", "service_category").agg(
        X.ratio(F.count_if("is_failed_transaction"), F.count_if("is_completed_transaction")).alias("failed_per_completed"),
        X.ratio(F.count(F.lit(1)), F.count_if(F.col("transaction_status") == "unknown")).alias("always_null"))


@on_lazy
def agg_min_max(w):
    return w["stg_subscriptions"].agg(
        F.min("started_at").cast("date").alias("first_start"),
        F.max(F.greatest("started_at", "cancelled_at", "updated_at")).cast("date").alias("last_change"))


@on_lazy
def agg_avg(w):
    return evidence.daily_roles(w["mart_user_transaction_activity"]).select("metric_date", "role", "avg_failure_rate")


@on_lazy
def agg_of_agg(w):
    return reporting.daily_features(w["mart_feature_adoption"])


@on_lazy
def agg_group_expr(w):
    at = F.col("transaction_timestamp")
    return w["stg_transactions"].groupBy(X.week_of(at).alias("week"), X.month_of(at).alias("month")).agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("transaction_amount").alias("amount"))


@on_lazy
def select_distinct(w):
    return w["stg_subscriptions"].select("plan_id", "monthly_price", "billing_period").distinct()


# --- windows, sorts, reshaping ----------------------------------------------------------

@on_lazy
def win_latest_row(w):
    newest = [F.desc_nulls_last("event_timestamp"), F.desc("event_id")]
    return latest_per_key(w["stg_product_events"], "user_id", newest) \
        .select("user_id", "event_id", "event_timestamp")


@on_lazy
def win_lag(w):
    """Previous value per metric; the generalised form with many series."""
    before = F.lag("current_value").over(Window.partitionBy("metric_name").orderBy("metric_date"))
    return anomaly.long_metrics(w["mart_daily_kpis"]).withColumn("previous_value", before)


def _health_series(w):
    by_day = Window.orderBy("metric_date")
    health = w["mart_transaction_health"].select("metric_date", "total_transactions", "completed_transaction_volume")
    return health, by_day


@on_lazy
def win_lag_carry(w):
    """All transactions as one series in time: a day's first one has its predecessor carried over from an earlier day."""
    rows = w["fact_transactions"].select("transaction_id", "transaction_timestamp", "transaction_status")
    lagged = lag_with_carry(rows, ["transaction_timestamp", "transaction_status"],
                            ["transaction_timestamp", "transaction_id"], F.to_date("transaction_timestamp"))
    at = F.col("transaction_timestamp").cast("long")
    return lagged.select("transaction_id", F.col("previous_transaction_status").alias("previous_status"),
                         (at - F.col("previous_transaction_timestamp").cast("long")).alias("seconds_since"))


@on_lazy
def win_dod_change(w):
    health, by_day = _health_series(w)
    total = F.col("total_transactions")
    return health.select("metric_date", (total - F.lag(total).over(by_day)).alias("change"))


@on_lazy
def win_dod_pct(w):
    health, by_day = _health_series(w)
    total = F.col("total_transactions")
    before = F.lag(total).over(by_day)
    return health.select("metric_date", X.ratio(total - before, before).alias("pct_change"))


@on_lazy
def sort_output(w):
    return w["mart_churn"].orderBy("metric_date")


@on_lazy
def topk_custom_rank(w):
    rows = w["mart_anomaly_candidates"].where("should_investigate")
    order = [evidence.severity_order(), F.desc("metric_date"), F.col("metric_name")]
    return topk.first_rows(rows, order, 10).select("metric_date", "metric_name", "severity")


@on_lazy
def topk_by_count(w):
    counted = w["fact_transactions"].groupBy("user_id", "payment_method").agg(F.count(F.lit(1)).alias("n"))
    return topk.first_rows(counted, [F.desc("n"), F.col("user_id"), F.col("payment_method")], 20)


@on_lazy
def topk_features(w):
    adoption = w["mart_feature_adoption"].select("metric_date", "feature_id", "total_feature_events")
    return topk.rank_within(adoption, ["metric_date"], [F.desc("total_feature_events"), F.col("feature_id")], 15)


@on_lazy
def sort_nulls_last(w):
    refunds = w["fact_transactions"].groupBy("user_id").agg(
        X.sum_where(F.col("is_refunded_transaction"), F.col("transaction_amount")).alias("refunded_amount"))
    return refunds.orderBy(F.desc_nulls_last("refunded_amount"), "user_id")


@on_lazy
def latest_and_previous(w):
    pair = serving.latest_and_previous(w["mart_transaction_health"])
    return pair.select(
        "latest.metric_date", F.col("latest.total_transactions").alias("latest_total"),
        F.col("previous.total_transactions").alias("previous_total"),
        F.expr("latest.total_transactions - previous.total_transactions").alias("change"))


@on_lazy
def union_all_unpivot(w):
    return anomaly.long_metrics(w["mart_daily_kpis"])


@on_lazy
def union_append(w):
    kinds = ["occurred_at", "user_id", "kind"]
    tx = w["stg_transactions"].select(F.col("transaction_timestamp").alias("occurred_at"), "user_id",
                                      F.lit("transaction").alias("kind"))
    events = w["stg_product_events"].select("user_id", F.col("event_timestamp").alias("occurred_at"),
                                            F.lit("event").alias("kind"))
    return tx.unionByName(events).select(*kinds)


@on_lazy
def melt_plan_mrr(w):
    return serving.series_mrr_by_plan(w["mart_mrr"])


@on_lazy
def fill_missing_days(w):
    """Days without failed transactions of small accounts' owners, added by gap filling."""
    owners = w["stg_users"].where("role = 'owner'").select("user_id")
    daily = w["fact_product_events"].where("is_failed_event").join(owners, "user_id") \
        .groupBy(F.col("event_date").alias("metric_date")).agg(F.count(F.lit(1)).alias("failed_events"))
    return fill_days(daily).select("metric_date", X.zero("failed_events").alias("failed_events"))


@on_lazy
def scalar_functions(w):
    """Every scalar function the models use, on all transactions with their users."""
    rows = w["raw_transactions"].join(w["raw_users"].select("user_id", "first_name", "last_name", "role",
                                                           "last_login_at"), "user_id", "left")
    amount, at = F.col("transaction_amount"), F.col("transaction_timestamp")
    digits = F.regexp_extract("user_id", r"(\d+)$", 1)
    return rows.select(
        "transaction_id",
        F.lower("transaction_status").alias("lowered"), F.upper("payment_method").alias("uppered"),
        X.display_name(F.lower("role")).alias("titled"),
        F.concat_ws(" ", "first_name", "last_name").alias("joined"),
        F.to_date(at).alias("day"), X.week_of(at).alias("week"), X.month_of(at).alias("month"),
        F.date_sub(F.to_date(at), 30).alias("month_before"),
        F.greatest(F.to_date(at), F.to_date("last_login_at")).alias("later"),
        F.least(F.to_date(at), F.to_date("last_login_at")).alias("earlier"),
        F.coalesce("refund_reason", "failure_reason", F.lit("none")).alias("reason"),
        F.nullif(F.lower("service_category"), F.lit("invoice")).alias("not_invoice"),
        F.abs(50000 - amount).alias("distance"),
        F.round(amount, 0).alias("rounded"),
        X.ratio(amount, F.nullif(digits.cast("bigint"), F.lit(0))).alias("safe_ratio"),
        F.when(amount < 20000, "small").when(amount < 60000, "medium").otherwise("large").alias("size_class"),
        digits.cast("bigint").alias("user_number"),
        F.lpad(digits.cast("bigint").cast("string"), 8, "0").alias("padded"),
        F.date_format(at, "yyyyMMdd").alias("compact_day"),
        F.col("user_id").startswith("usr_").alias("has_prefix"),
        X.percent(amount / 1000000, 2).alias("percent_text"),
        F.concat(F.lit("$"), X.grouped(amount)).alias("currency_text"),
    )


# --- evidence and serving -----------------------------------------------------------------

@on_built
def top_anomaly(w):
    return evidence.top_anomaly(w["mart_anomaly_candidates"]).drop("created_at")


@on_built
def top_anomaly_of_day(w):
    return evidence.top_anomaly(w["mart_anomaly_candidates"], DAY).drop("created_at")


@on_built
def classify_anomaly(w):
    return evidence.flagged_anomalies(w["mart_anomaly_candidates"]).select(
        "metric_date", "metric_name", "metric_category", "investigation_type")


def _day_evidence(kind: str, only: str | None = None):
    def run(w):
        sections = [evidence.PLAN_CONTEXT] if kind == "plan" else evidence.SECTIONS[kind]
        return evidence.evidence(w, [s for s in sections if only in (None, s.name)], DAY)
    return run


for _name, _kind, _only in (
    ("evidence_revenue", "revenue", None),
    ("evidence_churn", "churn", None),
    ("evidence_engagement", "engagement", None),
    ("evidence_plan", "plan", None),
    ("evidence_tx_trend", "transaction", "transaction_health_trend"),
    ("evidence_tx_plan", "transaction", "plan_performance"),
    ("evidence_tx_by_role", "transaction", "user_activity_by_role"),
    ("evidence_tx_failures", "transaction", "failure_breakdown"),
    ("evidence_tx_summary", "transaction", "transaction_summary"),
):
    _run = _day_evidence(_kind, _only)
    _run.__name__ = _name
    on_built(_run)


@on_built
def investigate_all(w):
    return evidence.investigate_all(w, evidence.flagged_anomalies(w["mart_anomaly_candidates"]))


@on_built
def report_text(w):
    return evidence.report_text(w, evidence.flagged_anomalies(w["mart_anomaly_candidates"]))


@on_built
def kpi_cards(w):
    return serving.kpi_cards(w["mart_daily_kpis"])


@on_built
def dashboard_filter(w):
    return serving.dashboard_filter(w["mart_anomaly_candidates"], categories=["revenue", "reliability"],
                                    flags_only=True).drop("created_at")


@on_built
def dashboard_date_range(w):
    return serving.dashboard_filter(w["mart_anomaly_candidates"], BATCH, DAY).drop("created_at")


@on_built
def anomaly_table(w):
    return serving.anomaly_table(w["mart_anomaly_candidates"])


def _series(name: str):
    def run(w):
        return serving.series(w["mart_daily_kpis"], name)
    run.__name__ = name
    on_built(run)


for _name in serving.SERIES:
    _series(_name)


@on_built
def series_mrr_by_plan(w):
    return serving.series_mrr_by_plan(w["mart_mrr"])


# --- data quality -----------------------------------------------------------------------------

@on_lazy
def check_not_null(w):
    return quality.not_null_failures(w["stg_transactions"], ["transaction_id", "user_id", "failure_reason"])


@on_lazy
def check_unique(w):
    return quality.unique_failures(w["stg_product_events"], "session_id")


@on_lazy
def check_accepted_values(w):
    return quality.accepted_failures(w["stg_transactions"], {
        "transaction_status": ["completed", "failed"], "failure_reason": ["unknown", "expired_card"]})


@on_lazy
def check_relationships(w):
    active = w["stg_users"].where("user_status = 'active'")
    return quality.relationship_failures(w["stg_transactions"], "user_id", active, "user_id")


@on_built
def quality_report(w):
    return quality.quality_report(w)


@on_built
def quality_gate(w):
    report = quality.quality_report(w)
    quality.quality_gate(report)
    return report.groupBy("rule").agg(F.count(F.lit(1)).alias("checks"), F.sum("failures").alias("failures"))


@on_session
def quality_report_incremental(spark, folder):
    """The facts' checks from state by batch day: a first report, a day loaded again, and the report after it."""
    places = _places(spark)
    store = RawStore(spark, places.raw)
    store.replace_all(raw_tables(spark, folder))
    models = ModelStore(spark, places.models)
    for table in check_state.FACTS:
        check_state.fact_report(models, store, table).collect()
        store.replace_batch(table, raw_tables(spark, folder)[table].where(F.col("batch_date") == F.lit(BATCH)), BATCH)
    reports = [check_state.fact_report(models, store, table) for table in check_state.FACTS]
    return reports[0].unionByName(reports[1])


@on_lazy
def approx_active_users(w):
    """Users of the last 7 and 30 days of every day: exact, and whether the sketches' estimate is near."""
    users = w["user_day_usage"].where("user_id is not null and metric_date is not null").select("metric_date", "user_id").distinct()
    days = users.select(F.col("metric_date").alias("day")).distinct()
    out = None
    for n in (7, 30):
        spread = each_day(users, F.col("metric_date"), F.date_add("metric_date", n - 1), "day")
        exact = (spread.join(days, "day", "left_semi").groupBy(F.col("day").alias("metric_date"))
                 .agg(F.count_distinct("user_id").alias("exact_users")))
        guess = sketches.rolling_users(w["daily_user_sketches"], n)
        near = F.abs(F.col("distinct_users") - F.col("exact_users")) <= F.col("exact_users") * F.lit(4 * sketches.ERROR) + 1
        one = exact.join(guess, "metric_date").select("metric_date", F.lit(n).alias("days"), "exact_users", near.alias("is_near"))
        out = one if out is None else out.unionByName(one)
    return out


# --- jobs -----------------------------------------------------------------------------------------

def _row_counts(w: Workspace, names) -> DataFrame:
    out = None
    for name in names:
        one = w[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("model"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def _places(spark: SparkSession) -> jobs.Places:
    root = shared_dir(spark)
    return jobs.Places(f"{root}/raw", f"{root}/models", f"{root}/reports")


@on_built
def build_models(w):
    return _row_counts(w, MODELS)


@on_session
def build_subset(spark, folder):
    """Transaction models only, with what they need."""
    w, names = lazy(spark, folder), ["mart_transaction_health", "mart_user_transaction_activity"]
    w.build(ModelStore(spark, shared_dir(spark)), names)
    return _row_counts(w, names)


@on_session
def run_backfill(spark, folder):
    places, csv = _places(spark), shared_dir(spark)
    for name, rows in raw_tables(spark, folder).items():
        write_raw_csv(rows, f"{csv}/{name}.csv")
    w = jobs.run_backfill(spark, places, csv, NOW)
    return _row_counts(w, [*RAW_TABLES, "mart_daily_kpis", "mart_anomaly_candidates"])


@on_session
def run_daily(spark, folder):
    """A day's batch arrives a second time: nothing doubles, its top move is reported."""
    places, batch = _places(spark), shared_dir(spark)
    store = RawStore(spark, places.raw)
    for name, rows in raw_tables(spark, folder).items():
        store.replace(name, rows)
        if name in DAILY_TABLES:
            write_raw_csv(rows.where(F.col("batch_date") == F.lit(BATCH)), f"{batch}/{name}.csv")
    w = jobs.run_daily(spark, places, batch, BATCH, NOW)
    reports = ReportStore(spark, places.reports).read()
    kept = w["fact_transactions"].agg(F.count(F.lit(1)).alias("n")).scalar()
    return reports.select("metric_date", "metric_name", "severity", "investigation_type", "summary", "evidence",
                          kept.alias("transactions_kept"))
