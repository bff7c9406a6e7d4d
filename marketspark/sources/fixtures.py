"""Raw tables derived from the driver's synthetic parquet tables.

The warehouse expects five e-commerce seed tables.  The test data ships
TPC-H-like tables instead, so this module maps them onto the raw schemas
(mixed case, stray spaces, NULLs, duplicates and sentinels included, so the
staging layer has real work to do).  The expressions are the fixed derivation
shared with the DuckDB oracle; the oracle has the same text in its dialect.

Everything here is a lazy projection/join over the driver tables, so the raw
tables grow with the scale factor.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from marketspark.sources.raw import conform_raw

DRIVER_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")

# Dedupe tie-break columns carried by raw_transactions (unique with timestamp).
TRANSACTION_TIE_BREAK = ("l_partkey", "l_suppkey", "l_extendedprice")


def read_driver_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in DRIVER_TABLES}


def raw_customers(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS customer_id",
        "date_add(DATE '1995-01-01', CAST(c_custkey*37 % 2400 AS INT)) AS signup_date",
        "CASE c_nationkey % 8 WHEN 0 THEN ' US ' WHEN 1 THEN 'uk' WHEN 2 THEN 'DE' WHEN 3 THEN 'au'"
        " WHEN 4 THEN 'BR' WHEN 5 THEN 'ca' WHEN 6 THEN 'IN' ELSE 'fr' END AS country",
        "CAST(18 + c_custkey % 60 AS INT) AS age",
        "CASE c_custkey % 3 WHEN 0 THEN 'Male ' WHEN 1 THEN 'female' ELSE 'other' END AS gender",
        "CASE WHEN c_acctbal>=9000 THEN 'Platinum' WHEN c_acctbal>=7000 THEN 'Gold'"
        " WHEN c_acctbal>=4000 THEN ' Silver' WHEN c_acctbal>=0 THEN 'BRONZE' END AS loyalty_tier",
        "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Organic' WHEN 'BUILDING' THEN ' Paid Search'"
        " WHEN 'AUTOMOBILE' THEN 'EMAIL' WHEN 'HOUSEHOLD' THEN 'social' END AS acquisition_channel",
    )


def raw_campaigns(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        "s_suppkey AS campaign_id",
        "CASE s_nationkey % 4 WHEN 0 THEN 'Email' WHEN 1 THEN ' paid search' WHEN 2 THEN 'SOCIAL'"
        " ELSE 'display' END AS channel",
        "CASE s_suppkey % 3 WHEN 0 THEN 'Acquisition' WHEN 1 THEN 'retention ' ELSE 'Reactivation' END AS objective",
        "date_add(DATE '1995-01-01', CAST(s_suppkey*11 % 2000 AS INT)) AS start_date",
        "date_add(DATE '1995-03-01', CAST(s_suppkey*11 % 2000 AS INT)) AS end_date",
        "CASE s_suppkey % 4 WHEN 0 THEN 'New' WHEN 1 THEN 'Loyal' WHEN 2 THEN 'churned'"
        " ELSE 'High Value' END AS target_segment",
        "s_acctbal/100000 AS expected_uplift",
    )


def raw_products(part: DataFrame) -> DataFrame:
    current = part.selectExpr(
        "p_partkey AS product_id",
        "CASE p_type WHEN 'STANDARD' THEN 'Electronics' WHEN 'ECONOMY' THEN ' home' WHEN 'MEDIUM' THEN 'Fashion'"
        " WHEN 'PROMO' THEN 'SPORTS' ELSE 'Beauty' END AS category",
        "p_brand AS brand",
        "p_retailprice AS base_price",
        "date_add(DATE '1994-01-01', CAST(p_partkey % 365 AS INT)) AS launch_date",
        "CAST(p_retailprice>=980 AS INT) AS is_premium",
    )
    # A later, stale duplicate for every tenth product: dedupe must keep the first.
    stale = part.where("p_partkey % 10 = 0").selectExpr(
        "p_partkey AS product_id",
        "'stale' AS category",
        "p_brand AS brand",
        "p_retailprice+1 AS base_price",
        "date_add(DATE '1996-01-01', CAST(p_partkey % 365 AS INT)) AS launch_date",
        "0 AS is_premium",
    )
    return current.unionByName(stale)


def raw_events(events: DataFrame) -> DataFrame:
    e = events.selectExpr(
        "event_id",
        "ts + make_ym_interval(0, CAST(user_id % 6 AS INT)) AS ts",
        "user_id",
        "event_type",
        "value",
        "CAST(get_json_object(props,'$.k') AS INT) AS k",
    )
    # Every hundredth event is repeated an hour later: dedupe keeps the first.
    late_copy = e.where("event_id % 100 = 0").selectExpr(
        "event_id", "ts + INTERVAL '1' HOUR AS ts", "user_id", "'error' AS event_type", "value", "k")
    f = e.unionByName(late_copy)
    return f.selectExpr(
        "event_id",
        "ts AS timestamp",
        "user_id AS customer_id",
        "CASE WHEN event_id % 50 = 7 THEN NULL"
        " ELSE concat(CAST(user_id AS VARCHAR(20)),'-',CAST(event_id % 2 AS VARCHAR(20))) END AS session_id",
        "CASE event_type WHEN 'view' THEN 'View' WHEN 'click' THEN ' click' WHEN 'signup' THEN 'add_to_cart'"
        " WHEN 'purchase' THEN 'PURCHASE' ELSE 'bounce' END AS event_type",
        "CASE WHEN k % 10 = 9 THEN NULL ELSE k END AS product_id",
        "CASE event_id % 3 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'desktop ' ELSE 'tablet' END AS device_type",
        "CASE event_id % 6 WHEN 0 THEN 'Email' WHEN 1 THEN 'paid search ' WHEN 2 THEN 'Organic'"
        " WHEN 3 THEN 'direct' WHEN 4 THEN 'social' END AS traffic_source",
        "user_id % 11 AS campaign_id",
        "CASE k % 3 WHEN 0 THEN 'Home' WHEN 1 THEN ' PDP' ELSE 'cart' END AS page_category",
        "value AS session_duration_sec",
        "CASE event_id % 4 WHEN 0 THEN 'Control' WHEN 1 THEN 'variant_a' WHEN 2 THEN ' Variant_B' END"
        " AS experiment_group",
    )


def raw_transactions(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    # Every line is a transaction; orders only contributes the customer key.  Every
    # fifth customer's lines have no product and no revenue, so there are non-buyers.
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                         "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    od = orders.select("o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    divisor = "CASE o_custkey % 5 WHEN 1 THEN 5000 WHEN 2 THEN 2000 ELSE 100 END"
    amount = f"CAST(floor(l_extendedprice*100 / {divisor}) AS DOUBLE)/100"
    return j.selectExpr(
        "l_orderkey*10+l_linenumber AS transaction_id",
        "l_shipdate AS timestamp",
        "o_custkey AS customer_id",
        "CASE WHEN l_orderkey % 10 = 3 OR o_custkey % 5 = 0 THEN NULL ELSE l_partkey END AS product_id",
        "CAST(l_quantity AS INT) AS quantity",
        "CAST(floor(l_extendedprice*l_discount) AS DOUBLE)/100 AS discount_applied",
        f"CASE WHEN l_orderkey % 10 = 3 OR o_custkey % 5 = 0 THEN NULL WHEN l_returnflag='R' AND l_linestatus='F' THEN -({amount})"
        f" ELSE {amount} END AS gross_revenue",
        "l_suppkey AS campaign_id",
        "CASE WHEN l_returnflag='R' AND (l_linestatus='F' OR l_linenumber=7) THEN 1 ELSE 0 END AS refund_flag",
        *TRANSACTION_TIE_BREAK,
    )


def raw_from_driver(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five conformed raw tables derived from ``sf_dir``'s driver tables."""
    d = read_driver_tables(spark, sf_dir)
    raw = {
        "customers": raw_customers(d["customer"]),
        "campaigns": raw_campaigns(d["supplier"]),
        "products": raw_products(d["part"]),
        "events": raw_events(d["events"]),
        "transactions": raw_transactions(d["lineitem"], d["orders"]),
    }
    return {t: conform_raw(t, df) for t, df in raw.items()}
