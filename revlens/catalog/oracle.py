"""Independent DuckDB SQL for every registered query.

Written from the meaning of each model: ranges are joined as ranges, distinct
users are counted as such, per-plan activity really fans out. Nothing of the
Spark side's rewrites is used, so agreement checks them. ``CTES`` are named
building blocks; a query gets exactly those it mentions.
"""

from __future__ import annotations

import re

from revlens.plans.anomaly import METRICS
from revlens.plans.evidence import PLAN_CONTEXT, SECTIONS
from revlens.plans.quality import SUITE, VOCABULARY
from revlens.plans.reporting import FEATURE_CATEGORIES
from revlens.plans.serving import ANOMALY_COLUMNS, SERIES
from revlens.sources.testtables import DUCKDB_VERSIONS, RAW_SQL

AS_OF = "DATE '2024-01-31'"
DAY = "DATE '2024-01-13'"
BATCH = "DATE '2024-01-10'"
PLANS = ("starter", "pro", "business")

CTES: dict[str, str] = {name: text.replace("{versions}", DUCKDB_VERSIONS) for name, text in RAW_SQL.items()}


def _folded(table: str, lower: str, upper: str = "") -> str:
    changes = [f"lower({c}) as {c}" for c in lower.split()] + [f"upper({c}) as {c}" for c in upper.split()]
    return f"select * exclude (batch_date) replace ({', '.join(changes)}) from {table}"


def _title(value: str) -> str:
    words = f"string_split(replace({value}, '_', ' '), ' ')"
    return f"array_to_string(list_transform({words}, lambda x: concat(upper(x[1]), lower(x[2:]))), ' ')"


def _rank(value: str, *ordered: str) -> str:
    return f"case {value} " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(ordered, 1)) + " end"


def _is(condition: str) -> str:
    return f"coalesce({condition}, false)"


def _rate(part: str, whole: str) -> str:
    return f"cast({part} as double) / nullif(cast({whole} as double), 0)"


def _long(value: str) -> str:
    return f"cast({value} as bigint)"


def _fixed(value: str, places: int) -> str:
    return f"cast(cast(round(cast({value} as decimal(38,12)), {places}) as decimal(38,{places})) as varchar)"


def _exact_avg(value: str) -> str:
    """Sum of the multiples of 2^-40 and of 2^-93 that each value consists of."""
    high, scale, both = f"floor({value} * 1099511627776)", "9007199254740992", "9903520314283042199192993792::double"
    low = f"floor(({value} * 1099511627776 - {high}) * {scale})"
    return (f"(sum(cast({high} as bigint))::double / 1099511627776::double + sum(cast({low} as bigint))::double / {both})"
            f" / count({value})::double")


def _pct(value: str, places: int = 1) -> str:
    # ``||`` and not concat, which would turn a missing number into a bare sign.
    return f"({_fixed(f'cast({value} as decimal(38,14)) * 100', places)} || '%')"


def _signed(text: str) -> str:
    return f"(case when {text} like '-%' then {text} else '+' || {text} end)"


def _grouped(value: str) -> str:
    return f"format('{{:,}}', cast(round(cast({value} as decimal(38,12)), 0) as bigint))"


CTES |= {
    "stg_accounts": _folded("raw_accounts", "industry company_size acquisition_channel account_status", "region"),
    "stg_users": _folded("raw_users", "role user_status device_preference notification_preference user_timezone"),
    "stg_features": _folded("raw_features", "feature_name feature_category minimum_plan feature_status "
                                            "adoption_difficulty retention_impact"),
    "stg_product_events": _folded("raw_product_events", "event_name device_type event_status failure_reason"),
    "stg_transactions": _folded("raw_transactions", "transaction_status payment_method service_category "
                                                    "customer_type failure_reason refund_reason"),
    "stg_subscriptions": _folded("raw_subscriptions", "plan_id billing_period subscription_status cancel_reason "
                                                      "payment_method") + """
        qualify row_number() over (partition by subscription_id
          order by updated_at desc nulls last, batch_date desc nulls last, cancelled_at desc nulls last) = 1""",

    "dim_accounts": f"""
        select account_id, account_name, industry, company_size, region, acquisition_channel, account_status,
          signup_date, created_at, cast(created_at as date) as account_created_date,
          updated_at, cast(updated_at as date) as account_updated_date,
          {_title('industry')} as industry_display_name, {_title('company_size')} as company_size_display_name,
          {_title('acquisition_channel')} as acquisition_channel_display_name,
          {_rank('company_size', 'solo', 'small', 'mid_market')} as company_size_rank,
          {_is("account_status = 'active'")} as is_active_account,
          {_is("account_status = 'churned'")} as is_churned_account,
          {_is(f"signup_date >= {AS_OF} - 30")} as is_new_account_30d
        from stg_accounts""",
    "dim_users": f"""
        select user_id, account_id, first_name, last_name, concat_ws(' ', first_name, last_name) as full_name,
          email, role, user_status, device_preference, notification_preference, user_timezone,
          onboarding_completed, created_at, cast(created_at as date) as user_created_date,
          last_login_at, cast(last_login_at as date) as last_login_date,
          if(onboarding_completed, 'completed_onboarding', 'not_completed_onboarding') as onboarding_segment,
          {_is("user_status = 'active'")} as is_active_user,
          {_is(f"last_login_at >= {AS_OF} - 30")} as is_recently_active_user,
          {_is(f"created_at >= {AS_OF} - 30")} as is_new_user_30d
        from stg_users""",
    "dim_features": f"""
        select *, {_rank('minimum_plan', *PLANS)} as minimum_plan_tier_rank,
          {_title('feature_name')} as feature_display_name,
          {", ".join(f"feature_status = '{s}' as is_{s}_feature" for s in ('active', 'beta', 'deprecated'))},
          {", ".join(f"minimum_plan = '{p}' as is_{p}_feature" for p in PLANS)},
          retention_impact = 'high' as is_high_retention_feature,
          case adoption_difficulty when 'low' then 'easy_adoption' when 'medium' then 'moderate_adoption'
            else 'hard_adoption' end as adoption_segment
        from stg_features""",
    "dim_plans": f"""
        select plan_id, monthly_price, monthly_price * 12 as annual_price, plan_tier_rank,
          {_title('plan_id')} as plan_display_name,
          prices * (select count(*) from stg_features where {_rank('minimum_plan', *PLANS)} <= plan_tier_rank)
            as available_feature_count,
          prices * (select count(*) from stg_features where is_core_feature
            and {_rank('minimum_plan', *PLANS)} <= plan_tier_rank) as available_core_feature_count,
          plan_id = 'starter' as is_entry_level_plan, plan_id = 'business' as is_enterprise_plan
        from (select *, count(*) over (partition by plan_id) as prices
              from (select distinct plan_id, monthly_price, {_rank('plan_id', *PLANS)} as plan_tier_rank
                    from stg_subscriptions) as d) as p""",
    "fact_product_events": f"""
        select event_id, user_id, session_id, feature_id, event_name, event_timestamp,
          cast(event_timestamp as date) as event_date,
          cast(date_trunc('week', event_timestamp) as date) as event_week,
          cast(date_trunc('month', event_timestamp) as date) as event_month,
          device_type, event_status, failure_reason,
          {_is("event_status = 'success'")} as is_successful_event, {_is("event_status = 'failed'")} as is_failed_event,
          if(event_status = 'success', 1, 0) as successful_event_count,
          if(event_status = 'failed', 1, 0) as failed_event_count
        from stg_product_events""",
    "fact_transactions": f"""
        select transaction_id, user_id, transaction_timestamp,
          cast(transaction_timestamp as date) as transaction_date,
          cast(date_trunc('week', transaction_timestamp) as date) as transaction_week,
          cast(date_trunc('month', transaction_timestamp) as date) as transaction_month,
          transaction_amount, transaction_status, payment_method, service_category, customer_type,
          failure_reason, refund_reason,
          {", ".join(_is(f"transaction_status = '{s}'") + f" as is_{s}_transaction"
                     for s in ('completed', 'failed', 'refunded', 'pending'))},
          if(transaction_status = 'completed', transaction_amount, 0) as completed_transaction_amount,
          {", ".join(f"if(transaction_status = '{s}', 1, 0) as {s}_transaction_count"
                     for s in ('failed', 'completed', 'refunded'))}
        from stg_transactions""",
    "subscription_calendar": """
        select cast(unnest(generate_series(first, last, interval 1 day)) as date) as metric_date
        from (select cast(min(started_at) as date) as first,
                cast(max(greatest(started_at, cancelled_at, updated_at)) as date) as last
              from stg_subscriptions) as b""",
    "fact_subs_by_day": f"""
        select metric_date, subscription_id, account_id, plan_id, monthly_price, billing_period,
          subscription_status, started_at, cancelled_at, cancel_reason, payment_method, auto_renew,
          discount_percent, sales_assisted, monthly_price as normalized_monthly_price,
          subscription_status <> 'trialing' and coalesce(cast(cancelled_at as date) > metric_date, true)
            as is_active_subscription,
          {_is("cast(cancelled_at as date) = metric_date")} as is_cancelled_on_date,
          cast(started_at as date) = metric_date as is_new_subscription_on_date
        from subscription_calendar join stg_subscriptions
          on metric_date between cast(started_at as date)
            and coalesce(cast(cancelled_at as date), DATE '9999-12-31')""",
    "mart_mrr": f"""
        select metric_date, count(distinct subscription_id) as active_subscriptions, sum(monthly_price) as mrr,
          {", ".join(f"sum(if(plan_id = '{p}', monthly_price, 0)) as {p}_mrr" for p in PLANS)},
          {", ".join(f"count(distinct subscription_id) filter (plan_id = '{p}') as active_{p}_subscriptions"
                     for p in PLANS)}
        from fact_subs_by_day where is_active_subscription group by metric_date""",
    "mart_churn": f"""
        select a.metric_date, a.n as active_subscriptions, coalesce(c.n, 0) as cancelled_subscriptions,
          {", ".join(f"coalesce(c.{p}, 0) as {p}_cancellations" for p in PLANS)},
          {_rate('coalesce(c.n, 0)', 'a.n')} as daily_churn_rate
        from (select metric_date, count(distinct subscription_id) as n from fact_subs_by_day
              where is_active_subscription group by 1) as a
        left join (select cast(cancelled_at as date) as metric_date, count(distinct subscription_id) as n,
                {", ".join(f"count(distinct subscription_id) filter (plan_id = '{p}') as {p}" for p in PLANS)}
              from fact_subs_by_day where cancelled_at is not null group by 1) as c using (metric_date)""",
    "mart_transaction_health": f"""
        select transaction_date as metric_date, count(*) as total_transactions,
          {", ".join(f"count(*) filter (transaction_status = '{s}') as {s}_transactions"
                     for s in ('completed', 'failed', 'refunded'))},
          sum(transaction_amount) filter (transaction_status = 'completed') as completed_transaction_volume,
          {_rate("count(*) filter (transaction_status = 'failed')", 'count(*)')} as transaction_failure_rate
        from fact_transactions group by 1""",
    "mart_user_transaction_activity": f"""
        select user_id, any_value(role) as role, any_value(user_status) as user_status,
          any_value(device_preference) as device_preference,
          any_value(onboarding_completed) as onboarding_completed, transaction_date as metric_date,
          count(transaction_id) as total_transactions,
          count(transaction_id) filter (is_completed_transaction) as completed_transactions,
          count(transaction_id) filter (is_failed_transaction) as failed_transactions,
          sum(transaction_amount) filter (is_completed_transaction) as completed_transaction_volume,
          {_rate('count(transaction_id) filter (is_failed_transaction)', 'count(transaction_id)')}
            as transaction_failure_rate
        from fact_transactions join dim_users using (user_id) group by user_id, transaction_date""",
    "event_calendar": """
        select cast(unnest(generate_series(first, last, interval 1 day)) as date) as metric_date
        from (select min(event_date) as first, max(event_date) as last from fact_product_events) as b""",
    "mart_user_engagement": f"""
        select metric_date, count(distinct user_id) as daily_active_users, count(event_id) as total_events,
          coalesce({_rate('count(event_id)', 'count(distinct user_id)')}, 0) as events_per_active_user,
          coalesce({_rate('sum(failed_event_count)', 'count(event_id)')}, 0) as event_failure_rate,
          count(distinct user_id) filter (onboarding_completed) as onboarded_active_users,
          coalesce({_rate('count(distinct user_id) filter (onboarding_completed)', 'count(distinct user_id)')}, 0)
            as onboarded_active_user_rate,
          count(distinct user_id) filter (device_type = 'mobile') as active_mobile_users,
          {", ".join(f"count(event_id) filter (feature_category = '{c}') as {c}_events" for c in FEATURE_CATEGORIES)}
        from event_calendar left join (
          select e.*, onboarding_completed, feature_category from fact_product_events e
          left join dim_users using (user_id) left join dim_features using (feature_id)) as x
          on event_date = metric_date
        group by metric_date""",
    "mart_feature_adoption": f"""
        select c.metric_date, f.feature_id, f.feature_name, f.feature_category, f.minimum_plan, f.is_core_feature,
          count(event_id) as total_feature_events, count(distinct e.user_id) as active_feature_users,
          count(distinct session_id) as feature_sessions,
          {_long('coalesce(sum(successful_event_count), 0)')} as successful_feature_events,
          {_long('coalesce(sum(failed_event_count), 0)')} as failed_feature_events,
          {", ".join(f"count(event_id) filter (role = '{r}') as {r}_feature_events" for r in ('owner', 'admin', 'staff'))},
          count(distinct e.user_id) filter (onboarding_completed) as onboarded_feature_users,
          count(distinct e.user_id) filter (is_active_user) as active_users_using_feature,
          count(distinct e.user_id) filter (is_new_user_30d) as new_users_using_feature,
          {", ".join(f"count(event_id) filter (device_type = '{d}') as {d}_events" for d in ('desktop', 'mobile', 'tablet'))},
          coalesce({_rate('count(event_id)', 'count(distinct e.user_id)')}, 0) as events_per_active_user,
          coalesce({_rate('sum(failed_event_count)', 'count(event_id)')}, 0) as feature_event_failure_rate
        from event_calendar c cross join dim_features f
        left join fact_product_events e on e.event_date = c.metric_date and e.feature_id = f.feature_id
        left join dim_users u on u.user_id = e.user_id
        group by all""",
    "plan_calendar": """
        select cast(unnest(generate_series(first, last, interval 1 day)) as date) as metric_date, plan_id
        from (select min(d) as first, max(d) as last from (
                select metric_date as d from fact_subs_by_day union all
                select transaction_date from fact_transactions union all
                select event_date from fact_product_events) as x) as b, dim_plans""",
    "plan_subscriptions": """
        select metric_date, plan_id,
          count(distinct subscription_id) filter (is_active_subscription) as active_subscriptions,
          count(distinct subscription_id) filter (is_new_subscription_on_date) as new_subscriptions,
          count(distinct subscription_id) filter (is_cancelled_on_date) as cancelled_subscriptions,
          sum(monthly_price) filter (is_active_subscription) as mrr
        from fact_subs_by_day group by 1, 2""",
    "user_plan_days": """
        select metric_date, user_id, plan_id, onboarding_completed
        from dim_users join fact_subs_by_day using (account_id) where is_active_subscription""",
    "plan_transactions": """
        select metric_date, plan_id, count(*) as total_transactions,
          count(*) filter (is_completed_transaction) as completed_transactions,
          count(*) filter (is_failed_transaction) as failed_transactions,
          sum(completed_transaction_amount) as completed_transaction_volume
        from fact_transactions t join user_plan_days p on p.user_id = t.user_id and metric_date = transaction_date
        group by 1, 2""",
    "plan_events": """
        select metric_date, plan_id, count(*) as events, count(distinct e.user_id) as users,
          sum(failed_event_count) as failed,
          count(distinct e.user_id) filter (onboarding_completed) as onboarded
        from fact_product_events e join user_plan_days p on p.user_id = e.user_id and metric_date = event_date
        group by 1, 2""",
    "mart_plan_performance": f"""
        select metric_date, plan_id, coalesce(active_subscriptions, 0) as active_subscriptions,
          coalesce(new_subscriptions, 0) as new_subscriptions,
          coalesce(cancelled_subscriptions, 0) as cancelled_subscriptions,
          {_rate('coalesce(cancelled_subscriptions, 0)', 'active_subscriptions')} as churn_rate,
          coalesce(mrr, 0) as mrr, {_rate('mrr', 'active_subscriptions')} as avg_revenue_per_subscription,
          {", ".join(f"coalesce({c}, 0) as {c}" for c in ('total_transactions', 'completed_transactions', 'failed_transactions'))},
          coalesce({_rate('failed_transactions', 'total_transactions')}, 0) as transaction_failure_rate,
          coalesce(completed_transaction_volume, 0) as completed_transaction_volume,
          coalesce(events, 0) as total_product_events, coalesce(users, 0) as active_users,
          coalesce({_rate('events', 'users')}, 0) as events_per_active_user,
          coalesce({_rate('failed', 'events')}, 0) as event_failure_rate,
          coalesce(onboarded, 0) as active_onboarded_users,
          coalesce({_rate('onboarded', 'users')}, 0) as onboarded_active_user_rate,
          {", ".join(f"coalesce((select sum(mrr) from plan_subscriptions q where q.metric_date = c.metric_date and q.plan_id = '{p}'), 0) as {p}_mrr" for p in PLANS)}
        from plan_calendar c left join plan_subscriptions using (metric_date, plan_id)
        left join plan_transactions using (metric_date, plan_id) left join plan_events using (metric_date, plan_id)""",
    "as_of": "select max(metric_date) as as_of_date from fact_subs_by_day",
    "mart_account_health": f"""
        select a.account_id, account_name, industry, company_size, region, acquisition_channel, account_status,
          signup_date, as_of_date,
          {", ".join(f"coalesce({c}, 0) as {c}" for c in ('total_users', 'active_users', 'onboarded_users', 'recently_active_users', 'active_subscriptions', 'current_mrr', 'active_users_30d', 'total_events_30d'))},
          coalesce({_rate('failed_30d', 'total_events_30d')}, 0) as event_failure_rate_30d,
          coalesce(total_transactions_30d, 0) as total_transactions_30d,
          coalesce(failed_transactions_30d, 0) as failed_transactions_30d,
          coalesce(completed_volume_30d, 0) as completed_volume_30d,
          {_rate('failed_transactions_30d', 'total_transactions_30d')} as transaction_failure_rate_30d,
          account_status = 'churned' or (coalesce(current_mrr, 0) > 0 and coalesce(active_users_30d, 0) = 0)
            as is_at_risk
        from dim_accounts a cross join as_of
        left join (select account_id, count(*) as total_users, count(*) filter (is_active_user) as active_users,
            count(*) filter (onboarding_completed) as onboarded_users,
            count(*) filter (is_recently_active_user) as recently_active_users
          from dim_users group by 1) as u using (account_id)
        left join (select account_id,
            count(distinct subscription_id) filter (is_active_subscription) as active_subscriptions,
            sum(normalized_monthly_price) filter (is_active_subscription) as current_mrr
          from fact_subs_by_day where metric_date = (select as_of_date from as_of) group by 1) as s using (account_id)
        left join (select account_id, count(distinct user_id) as active_users_30d, count(*) as total_events_30d,
            sum(failed_event_count) as failed_30d
          from fact_product_events join dim_users using (user_id), as_of
          where event_date between as_of_date - 29 and as_of_date group by 1) as e using (account_id)
        left join (select account_id, count(*) as total_transactions_30d,
            count(*) filter (is_failed_transaction) as failed_transactions_30d,
            sum(completed_transaction_amount) as completed_volume_30d
          from fact_transactions join dim_users using (user_id), as_of
          where transaction_date between as_of_date - 29 and as_of_date group by 1) as t using (account_id)""",
    "feature_days": f"""
        select metric_date, {_long('sum(total_feature_events)')} as total_feature_events,
          {_long('sum(active_feature_users)')} as active_feature_users,
          {_rate('sum(failed_feature_events)', 'sum(total_feature_events)')} as feature_event_failure_rate,
          {_rate('count(distinct feature_id) filter (total_feature_events > 0)', 'count(distinct feature_id)')}
            as feature_adoption_rate
        from mart_feature_adoption group by 1""",
    "kpi_calendar": """
        select cast(unnest(generate_series(first, last, interval 1 day)) as date) as metric_date
        from (select min(metric_date) as first, max(metric_date) as last from (
                select metric_date from mart_mrr union all select metric_date from mart_churn union all
                select metric_date from mart_transaction_health union all
                select metric_date from mart_user_engagement union all select metric_date from feature_days) as x) as b""",
    "kpi_base": f"""
        select metric_date, coalesce(mrr, 0) as mrr, coalesce(m.active_subscriptions, 0) as active_subscriptions,
          {_long('coalesce(new_subscriptions, 0)')} as new_subscriptions,
          {", ".join(f"coalesce({e}, 0) as {n}" for e, n in (
              ('cancelled_subscriptions', 'cancelled_subscriptions'), ('daily_churn_rate', 'churn_rate'),
              ('daily_active_users', 'daily_active_users'), ('total_events', 'total_product_events'),
              ('events_per_active_user', 'events_per_active_user'), ('event_failure_rate', 'event_failure_rate'),
              ('total_transactions', 'total_transactions'), ('completed_transactions', 'completed_transactions'),
              ('failed_transactions', 'failed_transactions'),
              ('transaction_failure_rate', 'transaction_failure_rate'),
              ('completed_transaction_volume', 'completed_transaction_volume'),
              ('total_feature_events', 'total_feature_events'), ('active_feature_users', 'active_feature_users'),
              ('feature_event_failure_rate', 'feature_event_failure_rate'),
              ('feature_adoption_rate', 'feature_adoption_rate')))}
        from kpi_calendar left join mart_mrr m using (metric_date) left join mart_churn c using (metric_date)
        left join (select metric_date, sum(new_subscriptions) as new_subscriptions from mart_plan_performance
                   group by 1) as n using (metric_date)
        left join mart_transaction_health using (metric_date) left join mart_user_engagement using (metric_date)
        left join feature_days using (metric_date)""",
    "kpi_previous": """
        select *, lag(mrr) over w as p_mrr, lag(daily_active_users) over w as p_users,
          lag(transaction_failure_rate) over w as p_failure, lag(churn_rate) over w as p_churn
        from kpi_base window w as (order by metric_date)""",
    "kpi_changes": f"""
        select * exclude (p_mrr, p_users, p_failure, p_churn), coalesce(mrr - p_mrr, 0) as mrr_dod_change,
          coalesce({_rate('mrr - p_mrr', 'p_mrr')}, 0) as mrr_dod_pct_change,
          coalesce(daily_active_users - p_users, 0) as daily_active_users_dod_change,
          coalesce(transaction_failure_rate - p_failure, 0) as transaction_failure_rate_dod_change,
          coalesce(churn_rate - p_churn, 0) as churn_rate_dod_change,
          coalesce(p_mrr <> 0 and abs(mrr - p_mrr) * 10 > abs(p_mrr), false) as jump
        from kpi_previous""",
    "mart_daily_kpis": """
        select * exclude (jump),
          round(cast(
            least(100, greatest(0, 50 + mrr_dod_pct_change * 100)) * cast(0.30 as double)
            + least(100, greatest(0, 100 - churn_rate * 1000)) * cast(0.25 as double)
            + least(100, greatest(0, 100 - transaction_failure_rate * 200)) * cast(0.25 as double)
            + least(100, greatest(0, 100 - event_failure_rate * 200)) * cast(0.20 as double)
            as decimal(20,12)), 2) as overall_health_score,
          jump or abs(churn_rate_dod_change) > cast(0.02 as double)
            or abs(transaction_failure_rate_dod_change) > cast(0.05 as double)
            or abs(daily_active_users_dod_change) > 50 as has_anomaly
        from kpi_changes""",
    "metric_values": " union all ".join(
        f"select metric_date, '{m}' as metric_name, '{c}' as metric_category, "
        f"cast({m} as decimal(31,12)) as cur, cast({t} as decimal(6,3)) as lim, '{k}' as kind from mart_daily_kpis"
        for m, c, t, k in METRICS),
    "metric_moves": """
        select *, abs(cur - prev) as move,
          case when kind = 'absolute_change' then cast(1 as decimal(31,12)) when prev <> 0 then abs(prev) end as base
        from (select *, lag(cur) over (partition by metric_name order by metric_date) as prev
              from metric_values) as v""",
    "mart_anomaly_candidates": f"""
        select metric_date, metric_name, metric_category, cast(cur as double) as current_value,
          cast(prev as double) as previous_value,
          cast(cast(cur - prev as decimal(31,9)) as double) as absolute_change,
          round({_rate('cur - prev', 'prev')}, 9) as percent_change, cast(lim as double) as threshold_value,
          case when prev is null then 'none'
            when move >= base * cast(lim * 2 as decimal(6,3)) then 'critical'
            when move >= base * cast(lim * 1.5 as decimal(6,3)) then 'high'
            when move >= base * lim then 'medium' else 'low' end as severity,
          case sign(cur - prev) when 1 then 'up' when -1 then 'down' else 'flat' end as anomaly_direction,
          coalesce(move > base * lim, false) as should_investigate
        from metric_moves""",
    "flagged": """
        select *, case when metric_name = 'event_failure_rate' or metric_category = 'engagement' then 'engagement'
            when metric_category = 'reliability' then 'transaction' when metric_category = 'retention' then 'churn'
            else 'revenue' end as investigation_type,
          case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 when 'low' then 4 else 5 end
            as urgency
        from mart_anomaly_candidates where should_investigate""",
    "daily_failures": """
        select transaction_date as metric_date, payment_method, failure_reason, count(*) as failed_count
        from fact_transactions where transaction_status = 'failed' group by all""",
    "daily_outcomes": """
        select transaction_date as metric_date, transaction_status, payment_method, service_category,
          count(*) as transaction_count, sum(completed_transaction_amount) as completed_amount
        from fact_transactions group by all""",
    "daily_roles": f"""
        select metric_date, role, count(*) as users, {_long('sum(failed_transactions)')} as failed_transactions,
          {_long('sum(total_transactions)')} as total_transactions,
          {_exact_avg('transaction_failure_rate')} as avg_failure_rate
        from mart_user_transaction_activity group by all""",
}

_WORD = re.compile(r"[a-z_][a-z_0-9]*")


def _with(final: str) -> str:
    """Prefix a query with the building blocks it needs, inputs first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in CTES and word not in ordered and text is not CTES[word]:
                visit(CTES[word])
                if word not in ordered:
                    ordered.append(word)

    visit(final)
    blocks = ",\n".join(f"{name} as ({CTES[name]})" for name in ordered)
    return f"with {blocks}\n{final}" if ordered else final


def _doubles(table: str, *columns: str, drop: str = "") -> str:
    keep = f"* exclude ({drop})" if drop else "*"
    return f"select {keep} replace ({', '.join(f'cast({c} as double) as {c}' for c in columns)}) from {table}"


_MRR = [f"{p}_mrr" for p in PLANS]
_KPI_MONEY = ("mrr", "completed_transaction_volume", "mrr_dod_change", "overall_health_score")

_MODELS = {
    "stg_accounts": "select * from stg_accounts",
    "stg_users": "select * from stg_users",
    "stg_subscriptions": _doubles("stg_subscriptions", "monthly_price", "discount_percent"),
    "stg_features": "select * from stg_features",
    "stg_product_events": "select * from stg_product_events",
    "stg_transactions": _doubles("stg_transactions", "transaction_amount"),
    "dim_accounts": "select * from dim_accounts",
    "dim_users": "select * from dim_users",
    "dim_plans": _doubles("dim_plans", "monthly_price", "annual_price"),
    "dim_features": "select * from dim_features",
    "fact_product_events": "select * from fact_product_events",
    "fact_transactions": _doubles("fact_transactions", "transaction_amount", "completed_transaction_amount"),
    "fact_subs_by_day": _doubles("fact_subs_by_day", "monthly_price", "discount_percent", "normalized_monthly_price"),
    "mart_mrr": _doubles("mart_mrr", "mrr", *_MRR),
    "mart_churn": "select * from mart_churn",
    "mart_transaction_health": _doubles("mart_transaction_health", "completed_transaction_volume"),
    "mart_user_transaction_activity": _doubles("mart_user_transaction_activity", "completed_transaction_volume"),
    "mart_user_engagement": "select * from mart_user_engagement",
    "mart_feature_adoption": "select * from mart_feature_adoption",
    "mart_plan_performance": _doubles("mart_plan_performance", "mrr", "completed_transaction_volume", *_MRR),
    "mart_account_health": _doubles("mart_account_health", "current_mrr", "completed_volume_30d"),
    "mart_daily_kpis": _doubles("mart_daily_kpis", *_KPI_MONEY),
    "mart_anomaly_candidates": "select * from mart_anomaly_candidates",
}

_SOURCES = {
    "scan_raw_csv": _doubles("raw_subscriptions", "monthly_price", "discount_percent"),
    "scan_raw_table": "select * from raw_product_events",
    "load_append": "select * from raw_users",
    "load_replace": "select * from raw_users",
    "load_stopped": """
        select batch_date, count(*) as transactions, count(transaction_amount) as amounts,
          cast(sum(transaction_amount) as double) as volume
        from raw_transactions group by batch_date""",
    "load_with_rejects": """
        select transaction_id, case lower(transaction_status) when 'failed' then 'transaction_amount'
          when 'refunded' then 'batch_date' else 'loaded' end as reason
        from raw_transactions""",
    "load_daily_batch": f"""
        select * replace (cast(transaction_amount + if(batch_date = {BATCH}, 1, 0) as double) as transaction_amount)
        from raw_transactions""",
    "write_batch_once": "select * from raw_accounts",
    "read_state": "select user_id, account_id from raw_users",
    "materialize_view": "select * from stg_users",
    "materialize_table": _doubles("fact_transactions", "transaction_amount", "completed_transaction_amount"),
    "param_query": f"""
        select transaction_id, user_id, cast(transaction_amount as double) as transaction_amount
        from fact_transactions where transaction_date = {DAY} and transaction_status = 'failed'""",
    "assign_entity_ids": """
        select o_orderkey, concat('usr_', if(n < 1000000, lpad(cast(n as varchar), 6, '0'), cast(n as varchar))) as user_id
        from (select o_orderkey, row_number() over (order by substr(md5(cast(o_orderkey as varchar)), 1, 3), o_orderkey)
                + (select max(cast(user_id[5:] as bigint)) from raw_users) as n from orders) as x""",
    "assign_daily_ids": """
        select source_id, event_date, concat('evt_', strftime(event_date, '%Y%m%d'), '_', lpad(cast(n as varchar), 6, '0')) as event_id
        from (select event_id as source_id, event_date, row_number() over (partition by event_date
                order by substr(md5(event_id), 1, 3), event_id) as n from fact_product_events) as x""",
    "records_json": """
        select cast(to_json(struct_pack(metric_date := metric_date, payment_method := payment_method,
          failure_reason := failure_reason, failed_count := failed_count)) as varchar) as record
        from (select * from daily_failures
              order by failed_count desc, metric_date, payment_method, failure_reason limit 25) as x""",
    "report_sink": """
        select metric_date, metric_name, severity, summary from report_texts
        where metric_date between DATE '2023-12-10' and DATE '2024-01-20'""",
}

_FILTERS = {
    "project_rename_cast": _MODELS["stg_transactions"],
    "normalize_case": """
        select industry, acquisition_channel, region, count(*) as accounts from stg_accounts group by all""",
    "flag_columns": """
        select transaction_id, is_completed_transaction, is_failed_transaction, is_refunded_transaction,
          is_pending_transaction from fact_transactions""",
    "indicator_counts": """
        select transaction_date, count(*) filter (transaction_status = 'completed') as completed_transaction_count,
          count(*) filter (transaction_status = 'failed') as failed_transaction_count,
          count(*) filter (transaction_status = 'refunded') as refunded_transaction_count,
          cast(sum(transaction_amount) filter (transaction_status = 'completed') as double) as completed_transaction_amount
        from fact_transactions group by 1""",
    "rank_map": f"""
        select account_id, {_rank('company_size', 'solo', 'small', 'mid_market')} as size_rank,
          {_rank('industry', 'cleaning', 'wellness')} as partial_rank from stg_accounts""",
    "display_name": """
        select industry_display_name, company_size_display_name, acquisition_channel_display_name,
          count(*) as accounts from dim_accounts group by all""",
    "segment_map": """
        select adoption_segment, count(*) as events from fact_product_events join dim_features using (feature_id)
        group by 1""",
    "filter_equality": "select metric_date, subscription_id from fact_subs_by_day where is_active_subscription",
    "filter_null": "select metric_date, subscription_id from fact_subs_by_day where cancelled_at is not null",
    "filter_in": """
        select subscription_id, subscription_status from stg_subscriptions
        where subscription_status in ('active', 'past_due', 'cancelled')""",
    "filter_between": _doubles("mart_transaction_health", "completed_transaction_volume")
                      + f" where metric_date between {DAY} - 7 and {DAY}",
    "filter_trailing_window": """
        select transaction_id, transaction_date from fact_transactions, as_of
        where transaction_date > as_of_date - 30 and transaction_date <= as_of_date""",
    "filter_recent": f"select user_id, last_login_at from stg_users where last_login_at >= {AS_OF} - 30",
    "filter_rownum": """
        select account_id, user_id, cast(1 as integer) as row_num from stg_users
        qualify row_number() over (partition by account_id order by created_at desc, user_id) = 1""",
}

_JOINS = {
    "join_inner": "select event_id, feature_id, feature_category from fact_product_events join dim_features using (feature_id)",
    "join_inner_composite": f"""
        select coalesce(t.metric_date, e.metric_date) as metric_date, coalesce(t.plan_id, e.plan_id) as plan_id,
          total_transactions, failed_transactions, events, coalesce(users, 0) as active_users
        from plan_transactions t full join plan_events e on t.metric_date = e.metric_date and t.plan_id = e.plan_id""",
    "join_left": """
        select e.user_id, event_date as metric_date, feature_id, any_value(role) as role, count(*) as events
        from fact_product_events e left join (select * from dim_users where is_active_user) as u using (user_id)
        group by 1, 2, 3""",
    "join_left_composite": """
        select c.metric_date, f.feature_id, nullif(count(distinct session_id), 0) as feature_sessions
        from event_calendar c cross join dim_features f left join fact_product_events e
          on e.event_date = c.metric_date and e.feature_id = f.feature_id group by 1, 2""",
    "join_left_then_not_null": """
        select role, count(distinct (user_id, transaction_date)) as user_days, count(transaction_id) as transactions
        from dim_users left join fact_transactions using (user_id) where transaction_date is not null group by role""",
    "join_cross_calendar": """
        select cast(d as date) as metric_date, plan_id from (
          select unnest(generate_series(min(x), max(x), interval 1 day)) as d from (
            select transaction_date as x from fact_transactions union all select event_date from fact_product_events) as y) as z
        cross join dim_plans""",
    "join_cross_scalar": "select account_id, as_of_date from dim_accounts cross join as_of",
    "join_interval": """
        select metric_date, subscription_id, plan_id from subscription_calendar, stg_subscriptions
        where cast(started_at as date) <= metric_date
          and (cancelled_at is null or cast(cancelled_at as date) >= metric_date)""",
    "join_theta_or": """
        select plan_id, count(feature_id) as available_feature_count,
          count(feature_id) filter (is_core_feature) as available_core_feature_count
        from (select distinct plan_id, monthly_price from stg_subscriptions) as p left join stg_features f
          on f.minimum_plan = p.plan_id or (f.minimum_plan = 'starter' and p.plan_id in ('pro', 'business'))
            or (f.minimum_plan = 'pro' and p.plan_id = 'business')
        group by 1""",
    "scalar_subquery": """
        select plan_id,
          least((select min(metric_date) from fact_subs_by_day), (select min(transaction_date) from fact_transactions),
                (select min(event_date) from fact_product_events)) as start_date,
          greatest((select max(metric_date) from fact_subs_by_day), (select max(transaction_date) from fact_transactions),
                (select max(event_date) from fact_product_events)) as end_date
        from dim_plans""",
    "join_anti_orphans": """
        select user_id, account_id from stg_users
        where not exists (select 1 from stg_product_events e where e.user_id = stg_users.user_id)""",
}

_AGGREGATES = {
    "agg_count": """
        select transaction_status, count(*) as all_rows, count(failure_reason) as with_reason
        from fact_transactions group by 1""",
    "agg_count_distinct": "select event_date, count(distinct user_id) as users from fact_product_events group by 1",
    "agg_count_distinct_case": """
        select event_date, count(distinct user_id) as users,
          count(distinct case when device_type = 'mobile' then user_id end) as mobile_users,
          count(distinct case when device_type = 'desktop' then user_id end) as desktop_users
        from fact_product_events group by 1""",
    "agg_filter_count": """
        select event_date, feature_id, count(*) filter (device_type = 'desktop') as desktop_events,
          count(*) filter (device_type = 'mobile') as mobile_events,
          count(*) filter (device_type = 'tablet') as tablet_events
        from fact_product_events group by 1, 2""",
    "agg_filter_distinct": """
        select metric_date, plan_id, active_subscriptions, new_subscriptions, cancelled_subscriptions
        from plan_subscriptions where active_subscriptions + new_subscriptions + cancelled_subscriptions > 0""",
    "agg_filter_sum": """
        select user_id, cast(sum(transaction_amount) filter (is_refunded_transaction) as double) as refunded_amount
        from fact_transactions group by 1""",
    "agg_sum_case_pivot": f"""
        select metric_date, {", ".join(f"cast({c} as double) as {c}" for c in _MRR)} from mart_mrr""",
    "agg_pivot_of_agg": f"""
        select cast(d as date) as metric_date, {", ".join(f"coalesce(any_value({p}), cast(0 as double)) as {p}" for p in PLANS)}
        from (select metric_date as d, {", ".join(f"cast(sum(mrr) filter (plan_id = '{p}') as double) as {p}" for p in PLANS)}
              from plan_subscriptions group by 1
              union all select metric_date, {", ".join("null" for _ in PLANS)} from subscription_calendar) as x
        group by 1""",
    "agg_ratio": f"""
        select payment_method, service_category,
          {_rate('count(*) filter (is_failed_transaction)', 'count(*) filter (is_completed_transaction)')} as failed_per_completed,
          cast(null as double) as always_null
        from fact_transactions group by 1, 2""",
    "agg_min_max": """
        select cast(min(started_at) as date) as first_start,
          cast(max(greatest(started_at, cancelled_at, updated_at)) as date) as last_change from stg_subscriptions""",
    "agg_avg": "select metric_date, role, avg_failure_rate from daily_roles",
    "agg_of_agg": "select * from feature_days",
    "agg_group_expr": """
        select transaction_week as week, transaction_month as month, count(*) as transactions,
          cast(sum(transaction_amount) as double) as amount from fact_transactions group by 1, 2""",
    "select_distinct": """
        select distinct plan_id, cast(monthly_price as double) as monthly_price, billing_period from stg_subscriptions""",
}

_WINDOWS = {
    "win_latest_row": """
        select user_id, event_id, event_timestamp from stg_product_events
        qualify row_number() over (partition by user_id order by event_timestamp desc, event_id desc) = 1""",
    "win_lag": """
        select metric_date, metric_name, cast(cur as double) as current_value, cast(prev as double) as previous_value
        from metric_moves""",
    "win_lag_carry": """
        select transaction_id, lag(transaction_status) over w as previous_status,
          cast(epoch(transaction_timestamp) - epoch(lag(transaction_timestamp) over w) as bigint) as seconds_since
        from fact_transactions window w as (order by transaction_timestamp nulls first, transaction_id nulls first)""",
    "win_dod_change": """
        select metric_date, total_transactions - lag(total_transactions) over (order by metric_date) as change
        from mart_transaction_health""",
    "win_dod_pct": f"""
        select metric_date, {_rate('total_transactions - before', 'before')} as pct_change
        from (select *, lag(total_transactions) over (order by metric_date) as before from mart_transaction_health) as x""",
    "sort_output": "select * from mart_churn order by metric_date",
    "topk_custom_rank": """
        select metric_date, metric_name, severity from flagged
        order by urgency, metric_date desc, metric_name limit 10""",
    "topk_by_count": """
        select user_id, payment_method, count(*) as n from fact_transactions group by 1, 2
        order by n desc, user_id, payment_method limit 20""",
    "topk_features": """
        select metric_date, feature_id, total_feature_events, cast(row_number() over w as integer) as record_no
        from mart_feature_adoption
        window w as (partition by metric_date order by total_feature_events desc, feature_id)
        qualify row_number() over w <= 15""",
    "sort_nulls_last": """
        select user_id, cast(sum(transaction_amount) filter (is_refunded_transaction) as double) as refunded_amount
        from fact_transactions group by 1 order by refunded_amount desc nulls last, user_id""",
    "latest_and_previous": """
        select metric_date, total_transactions as latest_total, previous_total, total_transactions - previous_total as change
        from (select *, lag(total_transactions) over (order by metric_date) as previous_total
              from mart_transaction_health) as x
        order by metric_date desc limit 1""",
    "union_all_unpivot": "select metric_date, metric_name, cast(cur as double) as current_value from metric_values",
    "union_append": """
        select transaction_timestamp as occurred_at, user_id, 'transaction' as kind from stg_transactions
        union all select event_timestamp, user_id, 'event' from stg_product_events""",
    "melt_plan_mrr": " union all ".join(
        f"select metric_date, '{p.title()}' as plan, cast({p}_mrr as double) as plan_mrr from mart_mrr" for p in PLANS),
    "fill_missing_days": """
        select cast(d as date) as metric_date, coalesce(n, 0) as failed_events
        from (select unnest(generate_series(min(day), max(day), interval 1 day)) as d from owner_failures) as c
        left join owner_failures on day = d""",
    "scalar_functions": f"""
        select transaction_id, lower(transaction_status) as lowered, upper(payment_method) as uppered,
          {_title('lower(role)')} as titled, concat_ws(' ', first_name, last_name) as joined,
          cast(transaction_timestamp as date) as day,
          cast(date_trunc('week', transaction_timestamp) as date) as week,
          cast(date_trunc('month', transaction_timestamp) as date) as month,
          cast(transaction_timestamp as date) - 30 as month_before,
          greatest(cast(transaction_timestamp as date), cast(last_login_at as date)) as later,
          least(cast(transaction_timestamp as date), cast(last_login_at as date)) as earlier,
          coalesce(refund_reason, failure_reason, 'none') as reason,
          nullif(lower(service_category), 'invoice') as not_invoice,
          cast(abs(50000 - transaction_amount) as double) as distance,
          cast(round(transaction_amount, 0) as double) as rounded,
          {_rate('transaction_amount', "cast(user_id[5:] as bigint)")} as safe_ratio,
          case when transaction_amount < 20000 then 'small' when transaction_amount < 60000 then 'medium'
            else 'large' end as size_class,
          cast(user_id[5:] as bigint) as user_number,
          lpad(cast(cast(user_id[5:] as bigint) as varchar), 8, '0') as padded,
          strftime(transaction_timestamp, '%Y%m%d') as compact_day,
          starts_with(user_id, 'usr_') as has_prefix,
          {_pct('cast(transaction_amount as decimal(30,14)) / 1000000', 2)} as percent_text,
          concat('$', {_grouped('transaction_amount')}) as currency_text
        from raw_transactions left join (select user_id, first_name, last_name, role, last_login_at from raw_users)
          as u using (user_id)""",
    "mart_mrr_from_days": """
        select metric_date, active_subscriptions, cast(mrr as double) as mrr from mart_mrr""",
}
CTES["owner_failures"] = """
    select event_date as day, count(*) as n from fact_product_events join dim_users using (user_id)
    where event_status = 'failed' and role = 'owner' group by 1"""


# --- evidence: the lists' columns, order and limits are part of the specification ---

_TABLE_MEASURES = {
    "mart_mrr": ["active_subscriptions", "mrr", *_MRR, *[f"active_{p}_subscriptions" for p in PLANS]],
    "mart_churn": ["active_subscriptions", "cancelled_subscriptions", *[f"{p}_cancellations" for p in PLANS],
                   "daily_churn_rate"],
    "mart_transaction_health": ["total_transactions", "completed_transactions", "failed_transactions",
                                "refunded_transactions", "completed_transaction_volume", "transaction_failure_rate"],
    "mart_user_engagement": ["daily_active_users", "total_events", "events_per_active_user", "event_failure_rate",
                             "onboarded_active_users", "onboarded_active_user_rate", "active_mobile_users",
                             *[f"{c}_events" for c in FEATURE_CATEGORIES]],
    "mart_plan_performance": ["active_subscriptions", "new_subscriptions", "cancelled_subscriptions", "churn_rate",
                              "mrr", "avg_revenue_per_subscription", "total_transactions", "completed_transactions",
                              "failed_transactions", "transaction_failure_rate", "completed_transaction_volume",
                              "total_product_events", "active_users", "events_per_active_user", "event_failure_rate",
                              "active_onboarded_users", "onboarded_active_user_rate", *_MRR],
}


def _evidence_list(section, days: str) -> str:
    """Long evidence rows of one list for the days in relation ``days``."""
    keys = section.key.split()
    measures = _TABLE_MEASURES[section.source] if section.measures == "*" else section.measures.split()
    key = f"concat_ws('|', {', '.join(f'coalesce({k}, {chr(39)}-{chr(39)})' for k in keys)})" if keys else "''"
    window = "s.metric_date between d.metric_date - 7 and d.metric_date" if section.trend \
        else "s.metric_date = d.metric_date"
    order = ", ".join(f"{w[1:]} desc nulls last" if w.startswith("-") else f"{w} nulls last"
                      for w in (section.order or "evidence_date").split())
    rows = (f"select d.metric_date, s.metric_date as evidence_date, s.* exclude (metric_date) "
            f"from (select distinct metric_date from {days}) as d join {section.source} s on {window}")
    numbered = f"select *, row_number() over (partition by metric_date order by {order}) as record_no from ({rows}) as r"
    pairs = ", ".join(f"struct_pack(m := '{m}', v := cast({m} as double))" for m in measures)
    return (f"select metric_date, '{section.name}' as section, cast(record_no as integer) as record_no, evidence_date, "
            f"record_key, x.m as measure, x.v as value from (select *, {key} as record_key, unnest([{pairs}]) as x "
            f"from ({numbered}) as n where record_no <= {section.limit}) as e")


CTES["the_day"] = f"select {DAY} as metric_date"
_EVIDENCE = {
    f"evidence_{kind}": " union all ".join(_evidence_list(s, "the_day") for s in SECTIONS[kind])
    for kind in ("revenue", "churn", "engagement")
}
_EVIDENCE["evidence_plan"] = _evidence_list(PLAN_CONTEXT, "the_day")
for _key, _name in (("trend", "transaction_health_trend"), ("plan", "plan_performance"),
                    ("by_role", "user_activity_by_role"), ("failures", "failure_breakdown"),
                    ("summary", "transaction_summary")):
    _EVIDENCE[f"evidence_tx_{_key}"] = next(
        _evidence_list(s, "the_day") for s in SECTIONS["transaction"] if s.name == _name)

_attached = [f"select metric_date, metric_name, investigation_type, e.* exclude (metric_date) from flagged "
             f"join ({_evidence_list(PLAN_CONTEXT, 'flagged')}) as e using (metric_date)"]
for _kind, _sections in SECTIONS.items():
    CTES[f"flagged_{_kind}"] = f"select * from flagged where investigation_type = '{_kind}'"
    for _section in _sections:
        _attached.append(
            f"select metric_date, metric_name, investigation_type, e.* exclude (metric_date) from flagged_{_kind} "
            f"join ({_evidence_list(_section, f'flagged_{_kind}')}) as e using (metric_date)")
_EVIDENCE["investigate_all"] = " union all ".join(_attached)

CTES["report_texts"] = f"""
    select metric_date, metric_name, metric_category, severity, investigation_type,
      concat({_title('metric_name')}, ' moved from ', {_fixed('previous_value', 4)}, ' to ', {_fixed('current_value', 4)},
        ' (', coalesce({_signed(_pct('percent_change'))}, {_signed(_fixed('absolute_change', 4))}), ') on ',
        cast(metric_date as varchar), '.') as summary,
      coalesce(nullif(concat_ws(chr(10),
        case when investigation_type = 'transaction' and failed_count is not null then
          concat('- Top failure pattern: ', coalesce(failure_reason, 'None'), ' via ', coalesce(payment_method, 'None'),
            ' (', failed_count, ' failures).') end,
        case when plan_id is not null then
          concat('- Highest plan failure rate: ', plan_id, ' at ', {_pct('plan_rate')}, '.') end,
        case when investigation_type = 'revenue' and exists (select 1 from mart_plan_performance p
            where p.metric_date = f.metric_date) then
          '- Plan-level MRR and subscription counts were pulled for the anomaly date.' end,
        case when investigation_type = 'churn' and daily_churn_rate is not null then
          concat('- Daily churn rate on anomaly date: ', {_pct('daily_churn_rate', 2)}, '.') end,
        case when investigation_type = 'engagement' and daily_active_users is not null then
          concat('- Daily active users: ', daily_active_users, ' with ', {_fixed('events_per_active_user', 2)},
            ' events per active user.') end), ''),
        '- Supporting mart queries were run, but no strong pattern emerged in the evidence.') as evidence
    from flagged f
    left join lateral (select payment_method, failure_reason, failed_count from daily_failures x
      where x.metric_date = f.metric_date
      order by failed_count desc, payment_method nulls last, failure_reason nulls last limit 1) as a on true
    left join lateral (select plan_id, transaction_failure_rate as plan_rate from mart_plan_performance x
      where x.metric_date = f.metric_date and transaction_failure_rate > 0
      order by transaction_failure_rate desc, plan_id limit 1) as b on true
    left join lateral (select daily_churn_rate from mart_churn x
      where x.metric_date between f.metric_date - 7 and f.metric_date order by x.metric_date desc limit 1) as c on true
    left join lateral (select daily_active_users, events_per_active_user from mart_user_engagement x
      where x.metric_date between f.metric_date - 7 and f.metric_date order by x.metric_date desc limit 1) as d on true"""

_ANOMALY = "select * exclude (investigation_type, urgency) from flagged"


def _card(position: int, field: str, label: str) -> str:
    change = f"(n.{field} - p.{field})"
    if field == "churn_rate":
        value, moved = _pct(f"n.{field}", 2), _signed(_pct(change, 2))
    elif field == "overall_health_score":
        value, moved = _fixed(f"n.{field}", 1), _signed(_fixed(change, 1))
    else:
        sign = "'$'" if field in ("mrr", "completed_transaction_volume") else "''"
        value, moved = f"{sign} || {_grouped(f'n.{field}')}", f"{sign} || {_signed(_grouped(change))}"
    return (f"select n.metric_date, cast({position} as integer) as position, '{field}' as field, '{label}' as label, "
            f"cast(n.{field} as double) as current_value, cast(p.{field} as double) as previous_value, "
            f"cast({change} as double) as change, {value} as display_value, {moved} as display_change "
            f"from last_days n left join last_days p on p.metric_date < n.metric_date where n.latest")


CTES["last_days"] = """
    select *, row_number() over (order by metric_date desc) = 1 as latest from mart_daily_kpis
    qualify row_number() over (order by metric_date desc) <= 2"""
_CARDS = [("mrr", "MRR"), ("active_subscriptions", "Active Subscriptions"),
          ("daily_active_users", "Daily Active Users"), ("churn_rate", "Churn Rate"),
          ("completed_transaction_volume", "Txn Volume"), ("overall_health_score", "Health Score")]

_SERVING = {
    "top_anomaly": f"{_ANOMALY} order by urgency, metric_date desc, metric_name limit 1",
    "top_anomaly_of_day": f"{_ANOMALY} where metric_date = {DAY} order by urgency, metric_name limit 1",
    "classify_anomaly": "select metric_date, metric_name, metric_category, investigation_type from flagged",
    "report_text": f"""
        select *, concat_ws(chr(10), '# Investigation Report', '', '## Anomaly Summary', summary, '',
            concat('Severity: ', severity, ', category: ', metric_category), '', '## Likely Root Cause',
            case when contains(evidence, chr(10)) then
                'Several of the signals below moved on the same day and may share a cause.'
              when starts_with(evidence, '- Supporting mart queries were run, but') then
                'The stored tables show no driver of this move.'
              else 'The signal below is the only one that stood out on that day and the first candidate to check.' end, '',
            '## Supporting Evidence', evidence, '', '## Recommended Next Steps',
            concat('- Look into the source records of ', cast(metric_date as varchar), '.'),
            '- See whether the next day''s value returns to its usual level.',
            '- Ask for this report again once the next batch is in.') as report
        from report_texts""",
    "kpi_cards": " union all ".join(_card(i, f, t) for i, (f, t) in enumerate(_CARDS, 1)),
    "dashboard_filter": """
        select * from mart_anomaly_candidates where should_investigate and metric_category in ('revenue', 'reliability')
          and metric_date >= (select max(metric_date) - 90 from mart_anomaly_candidates)""",
    "dashboard_date_range": f"select * from mart_anomaly_candidates where metric_date between {BATCH} and {DAY}",
    "anomaly_table": f"""
        select {", ".join(f"coalesce({_pct('percent_change')}, '—') as percent_change" if c == 'percent_change' else c
                          for c in ANOMALY_COLUMNS)} from mart_anomaly_candidates""",
    "series_mrr_by_plan": _WINDOWS["melt_plan_mrr"],
} | {
    name: "select metric_date, " + ", ".join(
        f"cast({c} as double) as {c}" if c in _KPI_MONEY else c for c in columns) + " from mart_daily_kpis"
    for name, columns in SERIES.items()
}


def _failures(model: str, column: str, rule: str, count: str) -> str:
    return f"select '{model}' as model, '{column}' as \"column\", '{rule}' as rule, {count} as failures from {model}"


def _checks() -> str:
    """One count per declared check, NULLs failing only ``not_null``."""
    parts = []
    for model, checks in SUITE.items():
        not_null = checks.not_null.split()
        if not_null[0] == "*":
            skipped = [w[1:] for w in not_null[1:]]
            if model == "mart_anomaly_candidates":
                skipped.append("created_at")
                parts.append(f"select '{model}', 'created_at', 'not_null', 0")
            not_null = [c for c in ["metric_date", *_STAR_COLUMNS[model]] if c not in skipped]
        parts += [_failures(model, c, "not_null", f"count(*) filter ({c} is null)") for c in not_null]
        parts += [_failures(model, c, "accepted_values", f"count(*) filter ({c} not in ({', '.join(repr(v) for v in VOCABULARY[c])}))")
                  for c in checks.accepted.split()]
        if checks.unique:
            parts.append(f"select '{model}', '{checks.unique}', 'unique', count(*) from (select {checks.unique} from {model} "
                         f"where {checks.unique} is not null group by 1 having count(*) > 1) as d")
        for column, (parent, key) in checks.parents.items():
            parts.append(f"select '{model}', '{column}', 'relationships', count(*) from {model} "
                         f"where {column} not in (select {key} from {parent})")
    parts.sort(key=lambda p: "as model" not in p)
    return " union all ".join(parts)


_STAR_COLUMNS = {
    "mart_user_engagement": _TABLE_MEASURES["mart_user_engagement"],
    "mart_plan_performance": ["plan_id", *_TABLE_MEASURES["mart_plan_performance"]],
    "mart_daily_kpis": [
        "mrr", "active_subscriptions", "new_subscriptions", "cancelled_subscriptions", "churn_rate",
        "daily_active_users", "total_product_events", "events_per_active_user", "event_failure_rate",
        "total_transactions", "completed_transactions", "failed_transactions", "transaction_failure_rate",
        "completed_transaction_volume", "total_feature_events", "active_feature_users",
        "feature_event_failure_rate", "feature_adoption_rate", "mrr_dod_change", "mrr_dod_pct_change",
        "daily_active_users_dod_change", "transaction_failure_rate_dod_change", "churn_rate_dod_change",
        "overall_health_score", "has_anomaly"],
    "mart_anomaly_candidates": ["metric_name", "metric_category", "current_value", "threshold_value", "severity",
                                "anomaly_direction", "should_investigate"],
}

_QUALITY = {
    "check_not_null": " union all ".join(
        f"select '{c}' as \"column\", 'not_null' as rule, count(*) - count({c}) as failures from stg_transactions"
        for c in ("transaction_id", "user_id", "failure_reason")),
    "check_unique": """
        select 'session_id' as "column", 'unique' as rule, count(*) as failures
        from (select session_id from stg_product_events group by 1 having count(*) > 1) as d""",
    "check_accepted_values": """
        select 'transaction_status' as "column", 'accepted_values' as rule,
          count(*) filter (transaction_status not in ('completed', 'failed')) as failures from stg_transactions
        union all select 'failure_reason', 'accepted_values',
          count(*) filter (failure_reason not in ('unknown', 'expired_card')) from stg_transactions""",
    "check_relationships": """
        select 'user_id' as "column", 'relationships' as rule, count(*) as failures from stg_transactions
        where user_id not in (select user_id from stg_users where user_status = 'active')""",
    "quality_report": _checks(),
    "quality_report_incremental": """
        select * from check_results
        where model in ('stg_transactions', 'fact_transactions', 'stg_product_events', 'fact_product_events')""",
    "approx_active_users": """
        select d as metric_date, cast(days as integer) as days, count(distinct user_id) as exact_users, true as is_near
        from (select distinct event_date as d from fact_product_events
              where user_id is not null and event_date is not null) as calendar,
          (values (7), (30)) as w(days), fact_product_events
        where event_date between d - days + 1 and d
        group by all""",
    "quality_gate": """
        select rule, count(*) as checks, cast(sum(failures) as bigint) as failures from check_results group by 1""",
}
CTES["check_results"] = _checks()


def _counts(*names: str) -> str:
    return " union all ".join(f"select '{n}' as model, count(*) as row_count from {n}" for n in names)


_JOBS = {
    "build_models": _counts(*_MODELS),
    "build_subset": _counts("mart_transaction_health", "mart_user_transaction_activity"),
    "run_backfill": _counts(*RAW_SQL, "mart_daily_kpis", "mart_anomaly_candidates"),
    "run_daily": f"""
        select metric_date, metric_name, severity, investigation_type, summary, evidence,
          (select count(*) from fact_transactions) as transactions_kept
        from report_texts where metric_date = {BATCH}
        order by case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 else 4 end, metric_name
        limit 1""",
}

ORACLE: dict[str, str] = {
    key: _with(text)
    for group in (_MODELS, _SOURCES, _FILTERS, _JOINS, _AGGREGATES, _WINDOWS, _EVIDENCE, _SERVING, _QUALITY, _JOBS)
    for key, text in group.items()
}
