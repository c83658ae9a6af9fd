"""Which days of the stored day tables a run has to make anew.

Every table by day notes the states of the tables it was made from. A later run compares
these with what is stored now: for an input by day the pointers tell which days have changed;
for a dimension the rows that differ, old and new, tell which days they weigh on. What is not
known any more, because a run is too long ago, has all days made anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.calendar import each_day
from revlens.plans.core import last_spine_day
from revlens.sources.model_store import ModelStore

Days = set[date | None]
DAY = "metric_date"


def changed_rows(then: DataFrame, now: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Signed differences: the old row (``sign`` -1) and the new row (+1) of every key whose columns differ."""
    old = then.select(key, F.struct(*columns).alias("old"))
    new = now.select(key, F.struct(*columns).alias("new"))
    pairs = old.join(new, key, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    signed = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("row")),
                     F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")))
    return (pairs.select(key, F.explode(signed).alias("s")).where("s.row is not null")
            .select(key, "s.sign", "s.row.*"))


def _days(frame: DataFrame) -> Days:
    """The distinct days of a frame: as many as the calendar has."""
    return {r[0] for r in frame.select(DAY).distinct().collect()}


def subscription_days_changed(columns: Sequence[str]) -> Callable[[DataFrame, DataFrame, ModelStore], Days]:
    """Days that the old or the new version of a changed subscription covers, and days that the calendar gained or lost."""
    def found(then: DataFrame, now: DataFrame, store: ModelStore) -> Days:
        signed = changed_rows(then, now, "subscription_id", [c for c in columns if c != "subscription_id"])
        ends = [frame.select(last_spine_day(frame).alias("d")).limit(1).collect() for frame in (then, now)]
        old_end, new_end = (e[0].d if e else None for e in ends)
        end = F.when(F.col("sign") < 0, F.lit(old_end).cast("date")).otherwise(F.lit(new_end).cast("date"))
        spans = each_day(signed, F.to_date("started_at"), F.coalesce(F.to_date("cancelled_at"), end))
        days = _days(spans)
        if old_end and new_end and old_end != new_end:
            low, high = sorted((old_end, new_end))
            days |= {low + timedelta(days=n) for n in range(1, (high - low).days + 1)}
        return days
    return found


def user_days_changed(columns: Sequence[str], tables: Sequence[str]) -> Callable[[DataFrame, DataFrame, ModelStore], Days]:
    """Days on which users whose columns changed have rows in the tables."""
    def found(then: DataFrame, now: DataFrame, store: ModelStore) -> Days:
        users = changed_rows(then, now, "user_id", columns).select("user_id").distinct()
        if users.isEmpty():
            return set()
        return set().union(*(_days(store.read(t).join(users, "user_id", "left_semi")) for t in tables))
    return found


_SPAN = ("subscription_id", "account_id", "plan_id", "subscription_status", "started_at", "cancelled_at")
_ROW = (*_SPAN, "monthly_price", "billing_period", "cancel_reason", "payment_method", "auto_renew",
        "discount_percent", "sales_assisted", "updated_at")
# What each table by day follows; None stands for an input by day.
FOLLOWS: Mapping[str, Mapping[str, Callable[[DataFrame, DataFrame, ModelStore], Days] | None]] = {
    "fact_subs_by_day": {"latest_subscriptions": subscription_days_changed(_ROW[:-1])},
    "mart_user_transaction_activity": {
        "user_day_transactions": None,
        "dim_users": user_days_changed(("role", "user_status", "device_preference", "onboarding_completed"),
                                       ["user_day_transactions"])},
    "account_day_activity": {
        "user_day_transactions": None, "user_day_usage": None,
        "dim_users": user_days_changed(("account_id", "onboarding_completed"), ["user_day_transactions", "user_day_usage"])},
    "daily_user_sketches": {"user_day_usage": None},
    "plan_day_activity": {"account_day_activity": None, "latest_subscriptions": subscription_days_changed(_SPAN)},
}


def basis(store: ModelStore, name: str) -> dict[str, str]:
    """The present states of what a table by day follows."""
    return {i: state for i in FOLLOWS.get(name, {}) if (state := store.state(i))}


def touched_days(store: ModelStore, name: str) -> Days | None:
    """Days of a stored table whose rows may have changed; None for all of them."""
    noted, touched = store.basis(name), set()
    for source, changes in FOLLOWS[name].items():
        if source not in noted:
            return None
        if changes is None:
            found = store.changed_days(source, noted[source])
        elif noted[source] == store.state(source):
            found = set()
        else:
            try:
                then = store.read(source, noted[source])
            except LookupError:
                return None
            found = changes(then, store.read(source), store)
        if found is None:
            return None
        touched |= found
    return touched


def within(at: str, days: Iterable[date]) -> Column:
    """Whether a time falls on one of the days, as ranges that a scan can skip by."""
    wanted, condition = sorted(days), F.lit(False)
    first = previous = None
    for d in [*wanted, None]:
        if previous is not None and (d is None or d != previous + timedelta(days=1)):
            condition |= (F.col(at) >= F.lit(first)) & (F.col(at) < F.lit(previous + timedelta(days=1)))
            first = d
        first, previous = first or d, d
    return condition
