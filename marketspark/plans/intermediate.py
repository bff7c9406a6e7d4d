"""Intermediate models (I1-I5): funnel steps, cart activity, cohorts, orders, product funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions import exact_sum, money, money_mean, month_start, pct_rounded
from marketspark.operators import left_join_match_flag

# Funnel step of each event type (bounces are exits, not a step;
# other types such as 'browse' stay in the funnel with a NULL step).
FUNNEL_STEPS = {"view": 1, "click": 2, "add_to_cart": 3, "purchase": 4}


def int_funnel_steps(stg_events: DataFrame) -> DataFrame:
    step = F.lit(None).cast("int")
    for event_type, n in reversed(list(FUNNEL_STEPS.items())):
        step = F.when(F.col("event_type") == event_type, F.lit(n)).otherwise(step)
    # NOT IN ('bounce') also drops NULL event types.
    return stg_events.where(~F.col("event_type").isin("bounce")).select(
        "event_id", "session_id", "customer_id", "product_id", "campaign_id", "event_type",
        step.alias("funnel_step"), "event_timestamp")


def int_cart_activity(stg_events: DataFrame) -> DataFrame:
    """Add-to-cart events flagged by a purchase of the same product in the same session.

    Same rows as ``carts LEFT JOIN purchases ON (session, customer, product)``,
    including one copy per matching purchase.
    """
    keys = ["session_id", "customer_id", "product_id"]
    carts = stg_events.where(F.col("event_type") == "add_to_cart").select(
        "event_id", *keys, "campaign_id", F.col("event_timestamp").alias("added_to_cart_at"))
    purchases = stg_events.where(F.col("event_type") == "purchase").select(*keys)
    flagged = left_join_match_flag(carts, purchases, keys, "was_purchased", spread_by="event_id")
    return flagged.select(*keys, "campaign_id", "added_to_cart_at", "was_purchased")


def int_customer_cohorts(stg_customers: DataFrame) -> DataFrame:
    return stg_customers.select(
        "customer_id", "loyalty_tier", "acquisition_channel", "country", "signup_date",
        month_start("signup_date").alias("cohort_month"))


def int_customer_orders(stg_transactions: DataFrame) -> DataFrame:
    """Per customer with at least one valid purchase: order totals plus refunds.

    Valid purchases (revenue > 0) and full refunds (flagged, revenue < 0) are
    two conditional aggregates of one ``groupBy(customer_id)`` pass, instead of
    two aggregations and a join; the map-side partial aggregate collapses a
    hot customer's rows before the shuffle.  Revenue stays gross.
    """
    t = stg_transactions.where(F.col("product_id").isNotNull() & F.col("gross_revenue").isNotNull())
    valid = F.col("gross_revenue") > 0
    refund = F.col("is_refunded") & (F.col("gross_revenue") < 0)
    agg = t.groupBy("customer_id").agg(
        F.count_if(valid).alias("__valid_rows"),
        F.count(F.when(valid, F.col("transaction_id"))).alias("total_orders"),
        F.sum(F.when(valid, F.col("quantity"))).alias("total_items"),
        exact_sum(F.when(valid, F.col("gross_revenue"))).alias("__revenue"),
        exact_sum(F.when(valid, F.col("discount_applied"))).alias("__discount"),
        F.count(F.when(refund, F.col("transaction_id"))).alias("__refund_count"),
        exact_sum(F.when(refund, F.abs(F.col("gross_revenue")))).alias("__refund"),
        F.min(F.when(valid, F.col("transaction_timestamp"))).alias("first_order_date"),
        F.max(F.when(valid, F.col("transaction_timestamp"))).alias("last_order_date"),
    )
    # A NULL customer cannot match its refunds in the join formulation.
    known = F.col("customer_id").isNotNull()
    return agg.where(F.col("__valid_rows") > 0).select(
        "customer_id",
        "total_orders",
        "total_items",
        money("__revenue").alias("total_revenue"),
        money_mean("__revenue", "__valid_rows").alias("avg_order_value"),
        money("__discount").alias("total_discount"),
        F.when(known, F.col("__refund_count")).otherwise(F.lit(0).cast("bigint")).alias("total_refund_count"),
        F.coalesce(F.when(known, money("__refund")), F.lit(0.0)).alias("total_refund_value"),
        "first_order_date",
        "last_order_date",
    )


def int_product_funnel(int_funnel_steps: DataFrame) -> DataFrame:
    """Event counts per product for the four funnel types, plus step rates.

    One ``groupBy(product_id)`` with conditional counts replaces the
    count-per-(product, type) then pivot-by-MAX formulation.
    """
    counts = int_funnel_steps.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("event_type") == "add_to_cart").alias("add_to_carts"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
    )
    return counts.select(
        "product_id", "views", "clicks", "add_to_carts", "purchases",
        pct_rounded("clicks", "views").alias("view_to_click_pct"),
        pct_rounded("add_to_carts", "clicks").alias("click_to_cart_pct"),
        pct_rounded("purchases", "add_to_carts").alias("cart_to_purchase_pct"),
        pct_rounded("purchases", "views").alias("overall_conversion_pct"),
    )
