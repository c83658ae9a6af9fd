"""Raw tables derived from the TPC-H-like test tables.

Plain integer arithmetic on keys, in SQL text both Spark and DuckDB accept, so
that queries and their checks start from identical rows. ``{versions}`` is the
only engine-specific piece (one or two rows per subscription).
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from revlens.sources.feature_catalogue import FEATURES

AS_OF = date(2024, 1, 31)
RUN_TS = datetime(2024, 1, 31, 6, 0, 0)
SOURCES = ("customer", "orders", "lineitem", "events")

_DAY0 = "DATE '2023-12-01'"


def _id(prefix: str, number: str, width: int = 6) -> str:
    return f"concat('{prefix}', lpad(cast({number} as string), {width}, '0'))"


def _pick(number: str, *values: str) -> str:
    arms = " ".join(f"when {i} then {v}" if v == "null" else f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case ({number}) % {len(values)} {arms} end"


_ACCOUNT = "cast(floor(c_custkey / 3) as bigint)"
_SIGNUP = f"{_DAY0} + cast(c_custkey % 61 as int)"
_OPENED = _SIGNUP.replace("c_custkey", "k")


def _features_sql() -> str:
    """Features that events name, from the day of their first event; labels are the catalogue's."""
    def label(i: int) -> str:
        return _pick("k - 1", *[str(f[i]).lower() for f in FEATURES])

    return f"""
        select {_id('feat_', 'k')} as feature_id, {label(0)} as feature_name, {label(1)} as feature_category,
          {label(2)} as minimum_plan, cast({label(3)} as boolean) as is_core_feature, {label(4)} as feature_status,
          first_day as released_at, {label(5)} as adoption_difficulty, {label(6)} as retention_impact,
          first_day as batch_date
        from (select event_id % {len(FEATURES)} + 1 as k, min(cast(ts as date)) as first_day
              from events group by event_id % {len(FEATURES)} + 1) as used"""


RAW_SQL = {
    # Customers by threes are the users of one account, which the first of them opens.
    "raw_accounts": f"""
        select {_id('acct_', 'account')} as account_id, name as account_name,
          case segment when 'BUILDING' then 'Consulting' when 'AUTOMOBILE' then 'Auto_Repair'
            when 'HOUSEHOLD' then 'Cleaning' else 'Wellness' end as industry,
          case when balance < 3000 then 'solo' when balance < 8000 then 'Small'
            else 'mid_market' end as company_size,
          {_pick('nation', 'ca', 'TX', 'ny', 'FL', 'WA')} as region,
          {_OPENED} as signup_date,
          {_pick('k', 'organic', 'Paid_Search', 'referral', 'social', 'partner')} as acquisition_channel,
          case when k % 60 = 0 then 'churned' when k % 21 = 0 then 'inactive' else 'active' end as account_status,
          cast({_OPENED} as timestamp) as created_at, cast({_OPENED} as timestamp) as updated_at,
          {_OPENED} as batch_date
        from (select {_ACCOUNT} as account, min(c_custkey) as k, min(c_name) as name, min(c_mktsegment) as segment,
                max(c_acctbal) as balance, min(c_nationkey) as nation
              from customer group by {_ACCOUNT}) as opened""",
    "raw_users": f"""
        select {_id('usr_', 'c_custkey')} as user_id, {_id('acct_', _ACCOUNT)} as account_id,
          case when c_custkey % 17 = 0 then null else c_name end as first_name,
          {_pick('c_custkey', 'Ada', 'Bo', 'Cy', 'Di')} as last_name,
          concat(lower(c_name), '@example.com') as email,
          {_pick('c_custkey', 'Owner', 'admin', 'staff', 'Billing_Manager', 'operations_manager')} as role,
          case when c_custkey % 25 = 7 then 'deactivated' when c_custkey % 20 = 3 then 'invited'
            else 'active' end as user_status,
          {_pick('c_custkey', 'desktop', 'Mobile', 'tablet', 'mixed')} as device_preference,
          {_pick('c_custkey', 'email', 'SMS', 'in_app', 'none')} as notification_preference,
          c_custkey % 6 <> 0 as onboarding_completed,
          cast({_SIGNUP} as timestamp) as created_at,
          case when c_custkey % 11 = 0 then null else cast({_SIGNUP} as timestamp) end as last_login_at,
          {_pick('c_custkey', 'America/Chicago', 'America/New_York', 'America/Denver')} as user_timezone,
          {_SIGNUP} as batch_date
        from customer""",
    "raw_subscriptions": f"""
        select {_id('sub_', 'k')} as subscription_id, {_id('acct_', 'cast(floor(k / 3) as bigint)')} as account_id,
          case plan when 'pro' then 'Pro' else plan end as plan_id,
          cast(case plan when 'business' then 199 when 'pro' then 79 else 29 end as decimal(18,2)) as monthly_price,
          case when k % 5 = 0 then 'annual' else 'Monthly' end as billing_period,
          case when version = 1 then 'Cancelled' when k % 50 = 1 then 'trialing'
            when k % 31 = 0 then 'past_due' else 'active' end as subscription_status,
          case when k % 2 = 0 then cast(started as timestamp) end as trial_started_at,
          case when k % 4 = 2 then cast(started as timestamp) end as trial_ended_at,
          cast(started as timestamp) as started_at,
          case when version = 1 then cast(gone as timestamp) end as cancelled_at,
          case when version = 1 then {_pick('k', 'Too_Expensive', 'low_usage', 'support_issue')} end as cancel_reason,
          {_pick('k', 'card', 'ach', 'Wallet')} as payment_method,
          k % 9 <> 0 as auto_renew, cast(10 * (k % 3) as decimal(5,2)) as discount_percent,
          k % 8 = 0 as sales_assisted,
          cast(case when version = 1 then gone else started end as timestamp) as updated_at,
          case when version = 1 then gone else started end as batch_date
        from (
          select k, version, started, started + 1 + cast(k % 11 as int) as gone,
            case when k % 7 = 0 then 'business' when k % 7 <= 3 then 'pro' else 'starter' end as plan
          from (
            select c_custkey as k, {{versions}} as version,
              {_DAY0} + cast(case when c_custkey % 10 = 6 then 40 else c_custkey * 37 % 55 end as int) as started
            from customer) as s) as v""",
    "raw_features": _features_sql(),
    "raw_product_events": f"""
        select {_id('evt_', 'event_id', 9)} as event_id, {_id('usr_', 'user_id')} as user_id,
          concat('ses_', cast(user_id as string), '_', cast(event_id % 977 as string)) as session_id,
          {_id('feat_', 'event_id % 15 + 1')} as feature_id,
          {_pick('event_id', *[f[0] for f in FEATURES])} as event_name,
          cast(ts as timestamp) as event_timestamp,
          case when event_id % 10 = 0 then 'Tablet' when event_id % 10 <= 3 then 'mobile'
            else 'desktop' end as device_type,
          case event_type when 'error' then 'Failed' else 'success' end as event_status,
          case when event_type = 'error' then {_pick('event_id', 'Validation_Error', 'timeout',
                'permission_denied', 'integration_error', 'unknown')} end as failure_reason,
          cast(ts as date) as batch_date
        from events""",
    "raw_transactions": f"""
        select concat('txn_', cast(l_orderkey as string), '_', cast(l_linenumber as string), '_',
            cast(l_partkey as string), '_', cast(l_suppkey as string), '_',
            cast(cast(l_shipdate as date) as string)) as transaction_id,
          {_id('usr_', 'o_custkey')} as user_id,
          cast({_DAY0} + dd as timestamp) as transaction_timestamp,
          cast(l_extendedprice as decimal(18,2)) as transaction_amount,
          status as transaction_status,
          case l_suppkey % 5 when 0 then 'ACH' when 1 then 'wallet' else 'card' end as payment_method,
          {_pick('l_linenumber', 'invoice', 'Appointment', 'deposit', 'consultation', 'follow_up',
                 'project_milestone', 'subscription')} as service_category,
          case when cast(l_quantity as bigint) % 2 = 0 then 'returning_customer' else 'New_Customer' end as customer_type,
          case when status = 'Failed' then {_pick('l_suppkey', 'card_declined', 'Insufficient_Funds',
                'expired_card', 'processor_error', 'fraud_flag', 'unknown')} end as failure_reason,
          case when status = 'refunded' then {_pick('l_suppkey', 'customer_request', 'service_cancelled',
                'Duplicate_Charge', 'billing_error')} end as refund_reason,
          {_DAY0} + dd as batch_date
        from (
          select *, case
              when l_partkey % 50 < case dd % 10 when 0 then 10 when 3 then 6 when 6 then 5 else 2 end then 'Failed'
              when l_returnflag = 'R' and l_linenumber = 7 then 'refunded'
              when l_linenumber = 6 and l_partkey % 10 = 9 then 'pending'
              else 'completed' end as status
          from (
            select *, cast((l_orderkey * 13 + l_partkey) % 61 as int) as dd
            from lineitem join orders on l_orderkey = o_orderkey) as j) as t""",
}

_TWO_ROWS = "case when c_custkey % 4 = 0 then {two} else {one} end"
SPARK_VERSIONS = "explode(" + _TWO_ROWS.format(two="array(0, 1)", one="array(0)") + ")"
DUCKDB_VERSIONS = "unnest(" + _TWO_ROWS.format(two="[0, 1]", one="[0]") + ")"


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six raw tables over ``folder``'s Parquet files."""
    frames = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in SOURCES}
    out = {}
    for name, text in RAW_SQL.items():
        text = text.replace("{versions}", SPARK_VERSIONS)
        used = {}
        for table, frame in frames.items():
            for word in (f"from {table}", f"join {table}"):
                if word in text:
                    text = text.replace(word, word.replace(table, "{" + table + "}"))
                    used[table] = frame
        out[name] = spark.sql(text, **used)
    return out
