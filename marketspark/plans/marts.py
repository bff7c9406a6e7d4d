"""Mart models (M1-M10): dimension and fact tables.

Each function is lazy; ``plans.warehouse.build_all`` writes them as Parquet in
dependency order and feeds the written tables to downstream marts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketspark.functions import (
    exact_sum,
    merged_sum,
    money,
    money_mean,
    month_diff,
    month_start,
    pct_rounded,
    round_half_away,
)
from marketspark.operators import distinct_state

ORDER_METRICS = ("total_orders", "total_items", "total_revenue", "avg_order_value", "total_discount",
                 "total_refund_count", "total_refund_value", "first_order_date", "last_order_date")

FUNNEL_METRICS = ("views", "clicks", "add_to_carts", "purchases", "view_to_click_pct", "click_to_cart_pct",
                  "cart_to_purchase_pct", "overall_conversion_pct")

# LTV segment thresholds on gross revenue (>= 1000 high, >= 300 mid, >= 1 low).
LTV_SEGMENTS = (("high", 1000), ("mid", 300), ("low", 1))


def dim_customers(stg_customers: DataFrame, int_customer_orders: DataFrame) -> DataFrame:
    """Every customer with order metrics (NULL when they never bought) and has_purchased.

    ``cohort_month`` is derived from the customer's own signup date instead of
    re-joining the cohort model on customer_id: same result while customer_id
    is unique (checked by the data tests), and no pairwise blow-up otherwise.
    A NULL customer_id never matches that join, so its cohort stays NULL.
    """
    orders = int_customer_orders.withColumn("__matched", F.lit(1))
    j = stg_customers.join(orders, "customer_id", "left")
    cohort = F.when(F.col("customer_id").isNotNull(), month_start("signup_date"))
    return j.select(
        "customer_id", "age", "gender", "country", "loyalty_tier", "acquisition_channel", "signup_date",
        cohort.alias("cohort_month"),
        *ORDER_METRICS,
        F.when(F.col("__matched").isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("has_purchased"),
    )


def dim_products(stg_products: DataFrame, int_product_funnel: DataFrame) -> DataFrame:
    j = stg_products.join(int_product_funnel, "product_id", "left")
    return j.select("product_id", "category", "brand", "base_price", "launch_date", "is_premium",
                    *FUNNEL_METRICS)


def dim_campaigns(stg_campaigns: DataFrame) -> DataFrame:
    # campaign_id 0 is the "no campaign" sentinel; != also drops NULL ids.
    return stg_campaigns.where(F.col("campaign_id") != 0).select(
        "campaign_id", "channel", "objective", "target_segment", "start_date", "end_date", "expected_uplift")


def fct_transactions(stg_transactions: DataFrame) -> DataFrame:
    valid = (F.col("product_id").isNotNull() & F.col("gross_revenue").isNotNull()
             & (F.col("gross_revenue") > 0))
    return stg_transactions.where(valid).select(
        "transaction_id", "customer_id", "product_id", "transaction_timestamp", "quantity", "gross_revenue",
        "discount_applied", "is_refunded", F.nullif(F.col("campaign_id"), F.lit(0)).alias("campaign_id"))


def fct_customer_metrics(dim_customers: DataFrame) -> DataFrame:
    rev = F.col("total_revenue")
    segment = F.lit("none")
    for name, threshold in reversed(LTV_SEGMENTS):
        segment = F.when(rev >= threshold, F.lit(name)).otherwise(segment)
    zero_long = F.lit(0).cast("bigint")
    return dim_customers.select(
        "customer_id", "age", "gender", "country", "loyalty_tier", "acquisition_channel", "signup_date",
        "cohort_month", "has_purchased",
        F.coalesce("total_orders", zero_long).alias("total_orders"),
        F.coalesce("total_items", zero_long).alias("total_items"),
        F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
        "avg_order_value",
        F.coalesce("total_discount", F.lit(0.0)).alias("total_discount"),
        F.coalesce("total_refund_count", zero_long).alias("total_refund_count"),
        F.coalesce("total_refund_value", F.lit(0.0)).alias("total_refund_value"),
        "first_order_date", "last_order_date",
        # Segment on the un-coalesced revenue: NULL and 0 < revenue < 1 are 'none'.
        segment.alias("ltv_segment"),
    )


def product_revenue(stg_transactions: DataFrame) -> DataFrame:
    """Revenue metrics per product over positive-revenue transactions."""
    t = stg_transactions.where((F.col("gross_revenue") > 0) & F.col("product_id").isNotNull())
    agg = t.groupBy("product_id").agg(
        # transaction_id is unique after staging, so COUNT(DISTINCT) is COUNT.
        F.count("transaction_id").alias("total_transactions"),
        F.countDistinct("customer_id").alias("unique_buyers"),
        exact_sum("gross_revenue").alias("__revenue"),
        F.count(F.lit(1)).alias("__rows"),
        F.min("gross_revenue").alias("__min"),
        F.max("gross_revenue").alias("__max"),
        exact_sum("discount_applied").alias("__discount"),
    )
    return agg.select(
        "product_id", "total_transactions", "unique_buyers",
        money("__revenue").alias("total_revenue"),
        money_mean("__revenue", "__rows").alias("avg_order_value"),
        round_half_away("__min").alias("min_order_value"),
        round_half_away("__max").alias("max_order_value"),
        money("__discount").alias("total_discount"),
    )


def fct_product_conversion(dim_products: DataFrame, stg_transactions: DataFrame) -> DataFrame:
    """Products with their funnel counts and zero-filled transaction revenue.

    The funnel columns are taken from ``dim_products`` (itself products left
    joined to the product funnel on the same key), which saves a second join.
    """
    rev = product_revenue(stg_transactions)
    j = dim_products.select("product_id", "category", "brand", "base_price", *FUNNEL_METRICS) \
        .join(rev, "product_id", "left")
    zero_long = F.lit(0).cast("bigint")
    return j.select(
        "product_id", "category", "brand", "base_price", *FUNNEL_METRICS,
        F.coalesce("total_transactions", zero_long).alias("total_transactions"),
        F.coalesce("unique_buyers", zero_long).alias("unique_buyers"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in
          ("total_revenue", "avg_order_value", "min_order_value", "max_order_value", "total_discount")],
    )


def fct_cohort_retention(int_customer_cohorts: DataFrame, fct_transactions: DataFrame) -> DataFrame:
    """Active customers, orders and revenue per (cohort month, order month).

    Same result as cohorts LEFT JOIN transactions grouped by the two months
    with COUNT(DISTINCT) customers/transactions, computed without distinct
    aggregates: transactions are first reduced to one row per (customer, order
    month) and cohorts to one row per (customer, cohort month) with its copy
    count, so the join is between two pre-aggregated sides and every joined
    row is one distinct customer of its group.  Unmatched customers and
    negative offsets drop out, so the join is inner.
    """
    tx = fct_transactions.groupBy("customer_id", month_start("transaction_timestamp").alias("order_month")).agg(
        F.count("transaction_id").alias("__orders"),
        exact_sum("gross_revenue").alias("__revenue"),
    )
    cohorts = int_customer_cohorts.groupBy("customer_id", "cohort_month").agg(
        F.count(F.lit(1)).alias("__copies"))
    j = cohorts.join(tx, "customer_id", "inner") \
        .withColumn("months_since_signup", month_diff("cohort_month", "order_month")) \
        .where(F.col("months_since_signup") >= 0)
    agg = j.groupBy("cohort_month", "order_month", "months_since_signup").agg(
        F.count(F.lit(1)).alias("active_customers"),
        F.sum("__orders").alias("total_orders"),
        merged_sum("__revenue", times="__copies").alias("__revenue"),
    )
    return agg.select("cohort_month", "order_month", "months_since_signup", "active_customers", "total_orders",
                      money("__revenue").alias("total_revenue"))


def agg_event_customers(stg_events: DataFrame) -> DataFrame:
    """Customers of the events as mergeable distinct states, per source, month, event type and experiment group.

    Any distinct customer count over these columns (R12, R13; the counts of the
    traffic and experiment marts equal its merges) is had from it without an event row.
    """
    d = stg_events.withColumn("event_month", month_start("event_timestamp"))
    return distinct_state(d, ["traffic_source", "event_month", "event_type", "experiment_group"], "customer_id")


def fct_traffic_conversion(stg_events: DataFrame) -> DataFrame:
    """Events and distinct customers per (traffic source, event type), with the source's share.

    The per-source total is a window sum over the already aggregated rows (a
    handful per source) rather than a second aggregation joined back.
    """
    agg = stg_events.groupBy("traffic_source", "event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )
    total = F.sum("event_count").over(Window.partitionBy("traffic_source"))
    return agg.select(
        "traffic_source", "event_type", "event_count", "unique_customers", total.alias("total_events"),
    ).withColumn("pct_of_traffic_events", pct_rounded("event_count", "total_events"))


def fct_traffic_monthly(stg_events: DataFrame) -> DataFrame:
    return stg_events.groupBy(
        "traffic_source", month_start("event_timestamp").alias("event_month"), "event_type",
    ).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )


def fct_experiment_groups(stg_events: DataFrame) -> DataFrame:
    base = stg_events.where(F.col("experiment_group").isNotNull()).groupBy("experiment_group").agg(
        F.count_if(F.col("event_type") == "view").alias("total_views"),
        F.count_if(F.col("event_type") == "click").alias("total_clicks"),
        F.count_if(F.col("event_type") == "add_to_cart").alias("total_add_to_cart"),
        F.count_if(F.col("event_type") == "purchase").alias("total_purchases"),
        F.count_if(F.col("event_type") == "bounce").alias("total_bounces"),
        F.countDistinct("customer_id").alias("total_customers"),
    )
    return base.select(
        "experiment_group", "total_views", "total_clicks", "total_add_to_cart", "total_purchases",
        "total_bounces", "total_customers",
        pct_rounded("total_purchases", "total_views").alias("purchase_rate"),
        pct_rounded("total_clicks", "total_views").alias("click_rate"),
        pct_rounded("total_add_to_cart", "total_views").alias("add_to_cart_rate"),
        pct_rounded("total_bounces", "total_views").alias("bounce_rate"),
    )
