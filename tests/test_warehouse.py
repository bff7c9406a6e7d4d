"""Full rebuild: CSV seeds in, Parquet marts out; documented invariants."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketspark.plans.warehouse import MARTS, build_all, build_models
from marketspark.sources import raw_from_driver, read_raw
from marketspark.sources.fixtures import TRANSACTION_TIE_BREAK
from marketspark.sources.schemas import RAW_TABLES

SF = "/root/testdata/sf0.001"
TIE = {"transactions": TRANSACTION_TIE_BREAK}


def same_rows(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def lazy_models(spark):
    return build_models(raw_from_driver(spark, SF), TIE)


def test_csv_seeds_to_parquet_marts(spark, lazy_models):
    root = tempfile.mkdtemp(prefix="marketspark-test-")
    seeds = os.path.join(root, "seeds")
    raw = raw_from_driver(spark, SF)
    for t in RAW_TABLES:
        raw[t].write.option("header", True).csv(os.path.join(seeds, f"{t}.csv"))
    loaded = read_raw(spark, seeds, fmt="csv")
    # Extra (tie-break) columns come back as text; restore their numeric order.
    loaded["transactions"] = loaded["transactions"].select(
        *[F.col(c).cast("double").alias(c) if c in TRANSACTION_TIE_BREAK else F.col(c)
          for c in loaded["transactions"].columns])
    built = build_all(spark, loaded, os.path.join(root, "warehouse"), TIE)
    for name in MARTS:
        assert os.path.isdir(os.path.join(root, "warehouse", "marts", name)), name
        assert same_rows(built[name], lazy_models[name]), name


def test_invariants(lazy_models):
    m = lazy_models
    stg_tx = m["stg_transactions"]
    nulls = stg_tx.where(F.col("product_id").isNull() | F.col("gross_revenue").isNull()).count()
    full_refunds = stg_tx.where(F.col("product_id").isNotNull() & (F.col("gross_revenue") <= 0)).count()
    assert m["fct_transactions"].count() == stg_tx.count() - nulls - full_refunds
    assert m["dim_customers"].count() == m["stg_customers"].count()
    assert m["dim_products"].count() == m["stg_products"].count()
    assert m["fct_customer_metrics"].where("has_purchased = 1").count() == m["int_customer_orders"].count()
    conv = m["fct_traffic_conversion"]
    assert conv.agg(F.sum("event_count")).first()[0] == m["stg_events"].count()
    monthly = m["fct_traffic_monthly"].agg(F.sum("event_count")).first()[0]
    assert monthly == m["stg_events"].count()


def test_sql_views_over_marts(spark, lazy_models):
    """Marts registered as views answer the page's own SQL (ad-hoc, read-only)."""
    from marketspark.plans import reports as R
    from marketspark.sources import register_views, run_sql

    register_views({n: lazy_models[n] for n in ("fct_transactions", "dim_campaigns", "dim_customers")})
    sql = run_sql(spark, """
        SELECT t.campaign_id, t.gross_revenue, t.is_refunded, c.channel, c.objective, c.target_segment,
               c.expected_uplift
        FROM fct_transactions t LEFT JOIN dim_campaigns c ON t.campaign_id = c.campaign_id
        WHERE t.campaign_id IS NOT NULL AND t.gross_revenue > 0""")
    api = R.campaign_transactions(lazy_models["fct_transactions"], lazy_models["dim_campaigns"])
    assert same_rows(sql, api.select(*sql.columns))
    kpi = run_sql(spark, "SELECT COUNT(DISTINCT customer_id) AS n FROM dim_customers").first().n
    assert kpi == R.kpi_overview(lazy_models["dim_customers"]).first().total_customers


def test_catalog_table_bucketed(spark, lazy_models):
    from marketspark.sources import save_as_table

    spark.conf.set("spark.sql.sources.bucketing.enabled", "true")
    t = save_as_table(spark, lazy_models["fct_transactions"], "fct_transactions_bucketed",
                      bucket_by=(4, "customer_id"))
    assert same_rows(t, lazy_models["fct_transactions"])
    plan = t.groupBy("customer_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # bucketed on the grouping key: no shuffle
    spark.sql("DROP TABLE fct_transactions_bucketed")


def test_cached_marts_serve_reports(spark, lazy_models):
    from marketspark.plans import reports as R
    from marketspark.plans.warehouse import cache_marts, release_marts

    cached = cache_marts(lazy_models, ["fct_product_conversion"])
    assert cached["fct_product_conversion"].storageLevel.useMemory
    a = R.revenue_by_category(cached["fct_product_conversion"])
    b = R.revenue_by_category(lazy_models["fct_product_conversion"])
    assert same_rows(a, b)
    release_marts(cached, ["fct_product_conversion"])


def test_dirty_csv_seeds(spark):
    """Column order, unknown columns, empty fields and text values in CSV seeds."""
    import datetime as dt

    from marketspark.plans.staging import stg_products, stg_transactions

    root = tempfile.mkdtemp(prefix="marketspark-csv-")
    with open(os.path.join(root, "transactions.csv"), "w") as f:
        f.write("refund_flag,transaction_id,timestamp,customer_id,product_id,quantity,discount_applied,"
                "gross_revenue,campaign_id,note\n"
                "True,1,2021-03-01 10:00:00,5,7,2.7,1.5,12.50,0,a\n"
                "0,1,2021-03-01T09:00:00,5,7,2.5,,9.99,3,b\n"
                ",2,,6,8,abc,0,-3,,c\n"
                "1,2,2021-02-01,6,8,3.5,0,4,2,d\n")
    with open(os.path.join(root, "products.csv"), "w") as f:
        f.write("product_id,category,brand,base_price,launch_date,is_premium\n"
                "7, Home ,Brand#1,19.99,2021-01-05,true\n"
                "7,stale,Brand#1,20.99,2022-01-05,0\n"
                "8,SPORTS,,5,,1\n")
    raw = read_raw(spark, root, fmt="csv", tables=("transactions", "products"))
    tx = sorted(stg_transactions(raw["transactions"]).collect(), key=lambda r: r.transaction_id)
    assert [(r.transaction_id, r.quantity, r.gross_revenue, r.is_refunded, r.campaign_id) for r in tx] == [
        (1, 2, 9.99, False, 3),                 # 09:00 copy wins; 2.5 rounds half to even
        (2, 4, 4.0, True, 2),                   # the copy with a time beats the empty one; 3.5 -> 4
    ]
    assert tx[0].transaction_timestamp == dt.datetime(2021, 3, 1, 9, 0)
    prods = sorted(stg_products(raw["products"]).collect(), key=lambda r: r.product_id)
    assert [(r.product_id, r.category, r.brand, r.launch_date, r.is_premium) for r in prods] == [
        (7, "home", "brand#1", dt.date(2021, 1, 5), True),
        (8, "sports", None, None, True),
    ]


def test_build_all_defaults_to_checkpoint_folder(spark):
    raw = raw_from_driver(spark, SF)
    built = build_all(spark, raw, tie_breaks=TIE)
    ckpt = spark.sparkContext.getCheckpointDir()
    files = built["dim_campaigns"].inputFiles()
    assert files and all(ckpt.replace("file:", "") in f for f in files)
