"""The model set: every model is a function whose parameters name its inputs."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.plans import anomaly, core, reporting, sketches, staging
from revlens.plans.refresh import FOLLOWS, basis, touched_days, within
from revlens.sources.day_table import on_days
from revlens.sources.model_store import ModelStore
from revlens.sources.raw_store import RawStore

STAGING = ("stg_accounts", "stg_users", "stg_subscriptions", "stg_features",
           "stg_product_events", "stg_transactions")
CORE = ("dim_accounts", "dim_users", "dim_plans", "dim_features",
        "fact_product_events", "fact_transactions", "fact_subs_by_day")
REPORTING = ("mart_mrr", "mart_churn", "mart_transaction_health", "mart_user_transaction_activity",
             "mart_user_engagement", "mart_feature_adoption", "mart_plan_performance",
             "mart_account_health", "mart_daily_kpis", "mart_anomaly_candidates")
# Shared pre-aggregates, stored so that facts are scanned once per build.
SHARED_STAGING = ("latest_subscriptions",)
SHARED_CORE = ("plan_days", "user_day_transactions", "user_day_usage", "daily_transaction_mix", "transaction_bounds",
               "event_bounds")
SHARED_REPORTING = ("subscription_days", "feature_sessions", "account_day_activity", "plan_day_activity")
OPTIONAL = ("daily_user_sketches",)
MODELS = STAGING + CORE + REPORTING
# What a full build stores: the models, and the day table that evidence is drawn from.
# Optional ones are built when they are named.
BUILT = (*MODELS, "daily_transaction_mix")

# Staging models are views. So are the two facts that are projections of raw rows: the
# raw store is laid out by batch date, and a copy would move all history on every run.
VIEWS = (*STAGING, "fact_product_events", "fact_transactions")

# Aggregates of a fact per day, stored by day: (fact, its day, the time that day comes
# from). A daily run refreshes the days that its batch touches and no others.
DAY_TABLES = {
    "user_day_transactions": ("fact_transactions", "transaction_date", "transaction_timestamp"),
    "daily_transaction_mix": ("fact_transactions", "transaction_date", "transaction_timestamp"),
    "user_day_usage": ("fact_product_events", "event_date", "event_timestamp"),
    "feature_sessions": ("fact_product_events", "event_date", "event_timestamp"),
}
BY_DAY = (*DAY_TABLES, *FOLLOWS)
Days = Mapping[str, Iterable[date | None]]


FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    name: getattr(module, name)
    for module, names in (
        (staging, STAGING + SHARED_STAGING),
        (core, CORE + SHARED_CORE),
        (reporting, SHARED_REPORTING + REPORTING[:-1]),
        (anomaly, REPORTING[-1:]),
        (sketches, OPTIONAL),
    )
    for name in names
}


def inputs_of(name: str) -> list[str]:
    """Names of the tables a model reads."""
    return [p for p in inspect.signature(FUNCTIONS[name]).parameters if p not in ("as_of", "run_ts", "only", "keep")]


def with_ancestors(names: Iterable[str]) -> list[str]:
    """The models and everything they read, inputs first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in FUNCTIONS and name not in ordered:
            for parent in inputs_of(name):
                visit(parent)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def waves(ordered: list[str]) -> list[list[str]]:
    """Split inputs-first models into groups that do not read one another."""
    depth: dict[str, int] = {}
    for name in ordered:
        depth[name] = 1 + max((depth.get(p, 0) for p in inputs_of(name)), default=0)
    return [[n for n in ordered if depth[n] == d] for d in sorted(set(depth.values()))]


@dataclass(frozen=True)
class Now:
    """The moment models refer to: the day for "last 30 days", the run's time stamp."""

    as_of: date
    run_ts: datetime


class Workspace:
    """Models over one set of raw tables, composed lazily or read from a store."""

    def __init__(self, raw: Mapping[str, DataFrame], now: Now):
        self._now = now
        self._frames: dict[str, DataFrame] = dict(raw)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            function = FUNCTIONS[name]
            given = inspect.signature(function).parameters
            extra = {k: getattr(self._now, k) for k in ("as_of", "run_ts") if k in given}
            self._frames[name] = function(*[self[p] for p in inputs_of(name)], **extra)
        return self._frames[name]

    def build(self, store: ModelStore, names: Iterable[str] = BUILT, threads: int = 4,
              days: Days | None = None, raw: RawStore | None = None) -> list[str]:
        """Materialise models and their ancestors; later models read the tables.

        ``days`` names, per fact, the days whose rows changed since the last build. Tables by
        day that are stored already are then refreshed for the days that changed, these or those
        that changed subscriptions and users weigh on. With ``raw``, which the raw tables come
        from, the latest subscriptions are merged from the stored ones and new batches.

        Models of one wave are written by concurrent jobs, so the tail of one
        leaves no executors idle.
        """
        done = with_ancestors(names)
        with ThreadPoolExecutor(threads) as pool:
            for wave in waves(done):
                tables = [n for n in wave if n not in VIEWS]
                frames = [self[n] for n in tables]
                stored = pool.map(lambda n, f: self._store(store, n, f, days, raw), tables, frames)
                self._frames |= zip(tables, stored, strict=True)
                for name in wave:
                    if name in VIEWS:
                        store.view(name, self[name])
        return done

    def _store(self, store: ModelStore, name: str, frame: DataFrame, days: Days | None, raw: RawStore | None) -> DataFrame:
        if name == "latest_subscriptions" and raw:
            return self._store_latest(store, name, frame, days, raw)
        if name not in BY_DAY:
            return store.table(name, frame)
        made_from = basis(store, name)
        touched = None
        if days is not None and store.has_days(name):
            touched = touched_days(store, name) if name in FOLLOWS else days.get(DAY_TABLES[name][0])
        if touched is None:
            return store.table(name, frame, "metric_date", made_from)
        return store.replace_days(name, self._on_days(name, frame, set(touched)), touched, made_from)

    def _on_days(self, name: str, frame: DataFrame, days: set[date | None]) -> DataFrame:
        """The model's rows of some days, read from these days of its inputs."""
        known = {d for d in days if d is not None}
        if name in DAY_TABLES:
            fact, day, at = DAY_TABLES[name]
            wanted = within(at, known)
            return FUNCTIONS[name](self[fact].where((wanted | F.col(day).isNull()) if None in days else wanted))
        if name == "fact_subs_by_day":
            return FUNCTIONS[name](self["stg_subscriptions"], only=known) if known else frame.limit(0)
        return FUNCTIONS[name](*[on_days(self[p], "metric_date", days) if p in BY_DAY else self[p] for p in inputs_of(name)])

    def _store_latest(self, store: ModelStore, name: str, frame: DataFrame, days: Days | None, raw: RawStore) -> DataFrame:
        """Latest rows by key, from the stored ones and the batches loaded since, if it is known which these are.

        A table of its own notes which raw rows the stored ones stand for.
        """
        source, noted = raw.table("raw_subscriptions"), f"{name}_from"
        now = str(source.snapshot().number)
        if days is not None and store.state(name) and store.state(noted):
            then = store.read(noted).first()
            batches = source.changed_days(int(then.raw)) if then.latest == store.state(name) else None
            if batches is not None:
                frame = staging.merged_subscriptions(store.read(name).select(*frame.columns), self["raw_subscriptions"], batches)
        stored = store.table(name, frame)
        spark = frame.sparkSession
        store.table(noted, spark.createDataFrame([(now, store.state(name))], "raw string, latest string"))
        return stored
