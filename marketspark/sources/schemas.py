"""Schemas of the five raw tables.

The raw files are CSV seeds with a header row.  Every column is read as text
and conformed by ``conform_raw`` with lenient casts, so a dirty value becomes
NULL instead of failing the whole load (the staging models then decide what
NULL means).  Parquet input that already carries typed columns goes through
the same conform step, where the casts are no-ops.
"""

from __future__ import annotations

from pyspark.sql import types as T

RAW_TABLES = ("customers", "campaigns", "products", "events", "transactions")

# Canonical (conformed) types of the columns the staging models read.
RAW_COLUMNS: dict[str, dict[str, T.DataType]] = {
    "customers": {
        "customer_id": T.LongType(),
        "signup_date": T.DateType(),
        "country": T.StringType(),
        "age": T.IntegerType(),
        "gender": T.StringType(),
        "loyalty_tier": T.StringType(),
        "acquisition_channel": T.StringType(),
    },
    "campaigns": {
        "campaign_id": T.LongType(),
        "channel": T.StringType(),
        "objective": T.StringType(),
        "start_date": T.DateType(),
        "end_date": T.DateType(),
        "target_segment": T.StringType(),
        "expected_uplift": T.DoubleType(),
    },
    "products": {
        "product_id": T.LongType(),
        "category": T.StringType(),
        "brand": T.StringType(),
        "base_price": T.DoubleType(),
        "launch_date": T.DateType(),
        "is_premium": T.StringType(),
    },
    "events": {
        "event_id": T.LongType(),
        "timestamp": T.TimestampNTZType(),
        "customer_id": T.LongType(),
        "session_id": T.StringType(),
        "event_type": T.StringType(),
        "product_id": T.LongType(),
        "device_type": T.StringType(),
        "traffic_source": T.StringType(),
        "campaign_id": T.LongType(),
        "page_category": T.StringType(),
        "session_duration_sec": T.DoubleType(),
        "experiment_group": T.StringType(),
    },
    "transactions": {
        "transaction_id": T.LongType(),
        "timestamp": T.TimestampNTZType(),
        "customer_id": T.LongType(),
        "product_id": T.LongType(),
        "quantity": T.DoubleType(),
        "discount_applied": T.DoubleType(),
        "gross_revenue": T.DoubleType(),
        "campaign_id": T.LongType(),
        "refund_flag": T.DoubleType(),
    },
}


