"""Staging models (S1-S5): clean, type and deduplicate each raw table.

Each model is a lazy ``DataFrame -> DataFrame`` function (a view).  Customers
and campaigns are cleaned 1:1; products, events and transactions keep the
earliest row per id (NULL dates/timestamps sort last, so a row with a known
time wins over one without).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions import clean_text, clean_text_or, to_bool_flag, to_double, to_int_rounded
from marketspark.operators import dedupe_first

UNKNOWN = "unknown"


def _tie_break(cols: Sequence[str]):
    return [F.col(c).asc_nulls_last() for c in cols]


def stg_customers(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id",
        F.col("signup_date").cast("date").alias("signup_date"),
        clean_text("country").alias("country"),
        "age",
        clean_text("gender").alias("gender"),
        clean_text_or("loyalty_tier", UNKNOWN).alias("loyalty_tier"),
        clean_text_or("acquisition_channel", UNKNOWN).alias("acquisition_channel"),
    )


def stg_campaigns(campaigns: DataFrame) -> DataFrame:
    return campaigns.select(
        "campaign_id",
        clean_text("channel").alias("channel"),
        clean_text("objective").alias("objective"),
        F.col("start_date").cast("date").alias("start_date"),
        F.col("end_date").cast("date").alias("end_date"),
        clean_text("target_segment").alias("target_segment"),
        to_double("expected_uplift").alias("expected_uplift"),
    )


def _to_boolean(c: str):
    # Numbers: non-zero is true; text: the usual true/false spellings.
    return F.coalesce(to_double(c) != F.lit(0.0), F.col(c).cast("string").try_cast("boolean"))


def stg_products(products: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    typed = products.select(
        "product_id",
        clean_text("category").alias("category"),
        clean_text("brand").alias("brand"),
        to_double("base_price").alias("base_price"),
        F.col("launch_date").cast("date").alias("launch_date"),
        _to_boolean("is_premium").alias("is_premium"),
        *tie_break,
    )
    deduped = dedupe_first(typed, ["product_id"], [F.col("launch_date").asc_nulls_last(), *_tie_break(tie_break)])
    return deduped.select("product_id", "category", "brand", "base_price", "launch_date", "is_premium")


def stg_events(events: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    # The NULL-session filter runs before dedupe (and is pushed to the scan):
    # a session-less copy must not win the dedupe and then be dropped.
    typed = events.where(F.col("session_id").isNotNull()).select(
        "event_id",
        F.col("timestamp").cast("timestamp_ntz").alias("event_timestamp"),
        "customer_id",
        "session_id",
        clean_text("event_type").alias("event_type"),
        "product_id",
        clean_text("device_type").alias("device_type"),
        clean_text_or("traffic_source", UNKNOWN).alias("traffic_source"),
        "campaign_id",
        clean_text("page_category").alias("page_category"),
        to_double("session_duration_sec").alias("session_duration_sec"),
        clean_text("experiment_group").alias("experiment_group"),
        *tie_break,
    )
    deduped = dedupe_first(typed, ["event_id"],
                           [F.col("event_timestamp").asc_nulls_last(), *_tie_break(tie_break)])
    return deduped.drop(*tie_break)


def stg_transactions(transactions: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    typed = transactions.select(
        "transaction_id",
        F.col("timestamp").cast("timestamp_ntz").alias("transaction_timestamp"),
        "customer_id",
        "product_id",
        to_int_rounded("quantity").alias("quantity"),
        to_double("discount_applied").alias("discount_applied"),
        to_double("gross_revenue").alias("gross_revenue"),
        "campaign_id",
        to_bool_flag("refund_flag").alias("is_refunded"),
        *tie_break,
    )
    deduped = dedupe_first(typed, ["transaction_id"],
                           [F.col("transaction_timestamp").asc_nulls_last(), *_tie_break(tie_break)])
    return deduped.drop(*tie_break)
