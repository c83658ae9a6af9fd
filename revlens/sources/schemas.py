"""Column names and types of the six raw tables.

``batch_date`` closes every table: it is the partition column of the raw store.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Raw column names and the types staging works with.
_COLUMNS = {
    "raw_accounts": """
        account_id string, account_name string, industry string, company_size string,
        region string, signup_date date, acquisition_channel string, account_status string,
        created_at timestamp, updated_at timestamp, batch_date date""",
    "raw_users": """
        user_id string, account_id string, first_name string, last_name string, email string,
        role string, user_status string, device_preference string,
        notification_preference string, onboarding_completed boolean, created_at timestamp,
        last_login_at timestamp, user_timezone string, batch_date date""",
    "raw_subscriptions": """
        subscription_id string, account_id string, plan_id string,
        monthly_price money, billing_period string, subscription_status string,
        trial_started_at timestamp, trial_ended_at timestamp, started_at timestamp,
        cancelled_at timestamp, cancel_reason string, payment_method string,
        auto_renew boolean, discount_percent percent, sales_assisted boolean,
        updated_at timestamp, batch_date date""",
    "raw_features": """
        feature_id string, feature_name string, feature_category string, minimum_plan string,
        is_core_feature boolean, feature_status string, released_at date,
        adoption_difficulty string, retention_impact string, batch_date date""",
    "raw_product_events": """
        event_id string, user_id string, session_id string, feature_id string,
        event_name string, event_timestamp timestamp, device_type string,
        event_status string, failure_reason string, batch_date date""",
    "raw_transactions": """
        transaction_id string, user_id string, transaction_timestamp timestamp,
        transaction_amount money, transaction_status string, payment_method string,
        service_category string, customer_type string, failure_reason string,
        refund_reason string, batch_date date""",
}

RAW_TABLES = tuple(_COLUMNS)
# The feature catalogue is loaded once; a daily batch never carries it.
DAILY_TABLES = tuple(t for t in RAW_TABLES if t != "raw_features")


_TYPES = {
    "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(), "money": T.DecimalType(18, 2), "percent": T.DecimalType(5, 2),
}


def raw_schema(table: str) -> T.StructType:
    pairs = [column.split() for column in _COLUMNS[table].split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])
