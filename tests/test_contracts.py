"""Rules the models must keep: whole results, exact money, no silent loss, order, hot keys."""

from __future__ import annotations

import datetime as dt
import math
import os
import random
import re
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from marketspark import session
from marketspark.functions import exact_sum, exact_total, merged_sum
from marketspark.operators import left_join_match_flag
from marketspark.operators.joins import match_counts
from marketspark.operators.skew import PART, heavy_keys, spread_sides
from marketspark.plans import intermediate as I
from marketspark.plans import marts as M
from marketspark.plans import quality as Q
from marketspark.plans import reports as R
from marketspark.plans import staging as S
from marketspark.plans.registry import models_for
from marketspark.plans.warehouse import build_all
from marketspark.sources import read_raw, read_rejected
from marketspark.sources.raw import conform_raw

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def models(spark):
    return models_for(spark, SF)


# --------------------------------------------------------------- whole results

def test_cohort_matrix_has_every_offset(spark):
    day = dt.date(2010, 1, 1)
    mart = spark.createDataFrame([(day, 0, 10.0), (day, 84, 50.0), (dt.date(2010, 2, 1), 140, 5.25)],
                                 "cohort_month date, months_since_signup long, total_revenue double")
    got = {(r[0], r[1]): r[2] for r in R.cohort_matrix(mart).collect()}
    assert got == {("2010-01", 0): 10.0, ("2010-01", 84): 50.0, ("2010-01", 140): 0.0,
                   ("2010-02", 0): 0.0, ("2010-02", 84): 0.0, ("2010-02", 140): 5.25}
    wide = R.cohort_matrix_wide(mart)
    assert wide.columns == ["cohort_month", "M0", "M84", "M140"]
    assert sum(sum(r[1:]) for r in wide.collect()) == 65.25


def test_hot_cart_key_is_joined_in_many_tasks(spark):
    n = 60_000
    hot = n // 3
    carts = spark.range(n).select(
        F.col("id").alias("event_id"), F.when(F.col("id") < hot, F.lit(1)).otherwise(F.col("id") % 3000 + 2).alias("k"))
    buys = spark.range(6000).select(F.when(F.col("id") < 3, F.lit(1)).otherwise(F.col("id") % 3000 + 2).alias("k"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = left_join_match_flag(carts, buys, ["k"], "hit", spread_by="event_id")
        shares = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(shares) < 0.25 * sum(shares)
        plain = carts.join(buys.withColumn("b", F.lit(1)), "k", "left").select("event_id", "k", F.coalesce("b", F.lit(0)).alias("hit"))
        both = out.select("event_id", "k", "hit")
        assert both.exceptAll(plain).count() == plain.exceptAll(both).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_only_heavy_keys_are_copied(spark):
    """Without skew no right row is copied; a key with a third of the rows gets parts in proportion, no other key does."""
    even = spark.range(60_000).select(F.col("id").alias("event_id"), (F.col("id") % 20_000).alias("k"))
    buys = match_counts(spark.range(20_000).select(F.col("id").alias("k")), ["k"])
    left, right = spread_sides(even, buys, ["k"], "event_id")
    assert right.count() == 20_000 and left.where(f"{PART} != 0").count() == 0
    hot = even.withColumn("k", F.when(F.col("event_id") < 20_000, F.lit(7)).otherwise(F.col("k")))
    left, right = spread_sides(hot, buys, ["k"], "event_id")
    parts = {r.k: r.n for r in right.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").collect()}
    assert set(parts) == {7} and 300 < parts[7] <= 400
    dealt = left.where("k = 7").groupBy(PART).count().agg(F.count("*"), F.max("count")).first()
    assert dealt[0] > 250 and dealt[1] < 200
    # A NULL key can be heavy as well; its rows match nothing and are spread.
    nulls = hot.withColumn("k", F.when(F.col("event_id") < 30_000, F.lit(None)).otherwise(F.col("k")).cast("long"))
    out = left_join_match_flag(nulls, buys, ["k"], "hit", spread_by="event_id")
    assert out.groupBy("hit").count().orderBy("hit").collect() == [(0, 30_000), (1, 30_000)]


def test_every_heavy_key_of_a_wide_table_is_found(spark):
    n = 400_000
    keys = spark.range(n).select(F.when(F.col("id") % 5 == 0, F.col("id") % 100).otherwise(F.col("id") + 1000).alias("k"))
    found = {r[0]: r[1] for r in heavy_keys(keys, ["k"]).collect()}
    heavy = {r.h for r in keys.where("k < 100").select(F.xxhash64("k").alias("h")).distinct().collect()}
    assert set(found) == heavy and set(found.values()) <= set(range(11, 13))  # 20 keys of 4,000 rows each


# ---------------------------------------------------------------- no silent loss

def test_integral_text_ids_are_read_exactly(spark):
    root = tempfile.mkdtemp(prefix="marketspark-csv-")
    rows = ["1,2021-01-01,1,12.0,1,0,5.0,3.0,0", "2,2021-01-01,90071992547409931.0,3,1,0,5.0,,0",
            "3,2021-01-02,1,abc,1,0,5.0,4,0", "4,2021-01-02,1,7.5,1,0,oops,4,0"]
    with open(os.path.join(root, "transactions.csv"), "w") as f:
        f.write("transaction_id,timestamp,customer_id,product_id,quantity,discount_applied,gross_revenue,campaign_id,refund_flag\n")
        f.write("\n".join(rows) + "\n")
    raw = read_raw(spark, root, tables=("transactions",))["transactions"]
    got = {r.transaction_id: r for r in raw.collect()}
    assert [got[i].product_id for i in (1, 2, 3, 4)] == [12, 3, None, None]
    assert got[1].campaign_id == 3 and got[2].customer_id == 90071992547409931
    lost = {r.column_name: r.rejected for r in read_rejected(spark, root, tables=("transactions",)).collect()}
    assert {k: v for k, v in lost.items() if v} == {"product_id": 2, "gross_revenue": 1}
    facts = M.fct_transactions(S.stg_transactions(raw))
    assert sorted(r.transaction_id for r in facts.collect()) == [1, 2]


# --------------------------------------------------------------------- money

def test_money_is_rounded_once_after_the_sum(spark):
    r = random.Random(21)
    rows = [(i, dt.datetime(2021, 1, 1 + i % 28), 1 + i % 7, 1 + i % 5, 1.0, round(r.uniform(0, 3), 3),
             round(r.uniform(0.2, 90), 3), 1 + i % 3, 0.0) for i in range(700)]
    rows += [(1000 + i, dt.datetime(2021, 2, 1), 99, 77, 1.0, 0.125, 10.005, 1, 0.0) for i in range(3)]
    names = "transaction_id timestamp customer_id product_id quantity discount_applied gross_revenue campaign_id refund_flag".split()
    stg = S.stg_transactions(conform_raw("transactions", spark.createDataFrame(rows, names)))
    con = duckdb.connect()
    cents = lambda values: con.execute("SELECT round(?, 2)", [math.fsum(values)]).fetchone()[0]
    for key, at, got in (("customer_id", 2, I.int_customer_orders(stg)), ("product_id", 3, M.product_revenue(stg))):
        want = {k: tuple(cents(x[i] for x in rows if x[at] == k) for i in (6, 5)) for k in {x[at] for x in rows}}
        assert {x[key]: (x.total_revenue, x.total_discount) for x in got.collect()} == want
    one = I.int_customer_orders(stg).where("customer_id = 99").first()
    assert (one.total_revenue, one.total_discount) == (30.02, 0.38)
    dims = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "campaign_id long, channel string") \
        .selectExpr("*", "'o' AS objective", "'s' AS target_segment", "0.0123456 AS expected_uplift")
    facts = M.fct_transactions(stg)
    totals = R.campaign_totals(facts, dims)
    sums = {c: math.fsum(x[6] for x in rows if x[7] == c) for c in (1, 2)}
    assert {x.channel: x.gross_revenue for x in R.revenue_by_channel(totals).collect()} == {"a": sums[1], "b": 2 * sums[2]}
    kpis = R.campaign_kpis(dims, totals).first()
    assert kpis.total_transactions == R.campaign_transactions(facts, dims).count()  # also with a campaign listed twice
    assert abs(kpis.avg_expected_uplift - 1.23456) < 1e-12
    chosen = R.campaign_totals(facts, dims, channel=["b"])
    assert {x.campaign_id for x in chosen.collect()} == {2}


def test_exact_sums_equal_fsum(spark):
    r = random.Random(31)
    cases = [[1 / 3] * 3, [1e21, 1.0, -1e21], [10.005] * 3, [0.1] * 10, [-0.1] * 10, [0.0], [-5.0, 5.0], [1e-5] * 7, [-1e21, 0.5, 1 / 3],
             [2.0 ** 53, 1.0, 1e-12], [2.0 ** 53, 1.0], [-(2.0 ** 53), -1.0, -(2.0 ** -40)], [1e28, 1e-10], [0.004] * 25]
    cases += [[r.uniform(-1, 1) * 10 ** r.randint(-10, 20) for _ in range(r.randint(1, 50))] for _ in range(200)]
    rows = [(i, x) for i, c in enumerate(cases) for x in c] + [(1000, float("inf")), (1000, 1.0), (1001, 1e40), (1001, 1e40), (1002, None)]
    d = spark.createDataFrame(rows, "k int, x double")
    got = {a.k: a.t for a in d.repartition(5).groupBy("k").agg(exact_sum("x").alias("s")).select("k", exact_total("s").alias("t")).collect()}
    assert all(got[i] == math.fsum(c) for i, c in enumerate(cases))
    assert (got[1000], got[1001], got[1002]) == (float("inf"), 2e40, None)
    parts = d.where("k < 1000").groupBy("k", (F.col("x") > 0).alias("p")).agg(exact_sum("x").alias("s"))
    thrice = parts.groupBy("k").agg(merged_sum("s", times=F.lit(3)).alias("s")).select("k", exact_total("s").alias("t"))
    assert {a.k: a.t for a in thrice.collect()} == {i: math.fsum(c * 3) for i, c in enumerate(cases)}
    assert "decimal(" not in parts._jdf.queryExecution().executedPlan().toString()


def test_campaign_reports_join_no_fact_row(spark, models):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    try:
        facts = spark.range(1000).selectExpr("id % 7 + 1 AS campaign_id", "1.5D AS gross_revenue", "false AS is_refunded")
        totals = R.campaign_totals(facts, models["dim_campaigns"])
        for df in (R.revenue_by_channel(totals), R.transactions_by_channel(totals), R.uplift_vs_revenue(models["dim_campaigns"], totals)):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            join, below = plan.index("Join"), plan.rindex("Range (0, 1000")
            assert "Aggregate [campaign_id" in plan[join:below], plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# --------------------------------------------------------------------- order

def test_reports_come_sorted(models):
    totals = R.campaign_totals(models["fct_transactions"], models["dim_campaigns"])
    products = models["fct_product_conversion"]
    conversion = models["fct_traffic_conversion"]
    reports = {
        "total_revenue": [R.revenue_by_acquisition(models["fct_customer_metrics"]), R.revenue_by_category(products), R.top20_products(products)],
        "rate": [R.purchase_rate_by_source(conversion), R.bounce_rate_by_source(conversion)],
        "avg_order_value": [R.aov_by_category(products)],
        "total_discount": [R.discount_by_category(products)],
        "gross_revenue": [R.revenue_by_channel(totals)],
        "transactions": [R.transactions_by_channel(totals)],
    }
    for column, frames in reports.items():
        for df in frames:
            values = [r[column] for r in df.collect()]
            assert len(values) > 1 and values == sorted(values)
    months = [(r.traffic_source, r.event_month) for r in R.monthly_volume(models["fct_traffic_monthly"]).collect()]
    assert months == sorted(months)


# ------------------------------------------------------------ folders and tests

def test_build_all_needs_a_shared_folder(models, monkeypatch):
    class Bare:
        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        session.scratch_root(Bare, "warehouse")
    with pytest.raises(ValueError):
        build_all(Bare, {})


def test_exchange_counts_of_whole_plans(models):
    """Planned from the raw tables, before AQE; a higher count is a regression."""
    exchanges = lambda df: len(re.findall(r"Exchange (?:hash|Single|range)", df._jdf.queryExecution().executedPlan().toString()))
    assert exchanges(Q.dq_report(models)) <= 42
    figures = {m: {f"nulls:{c}": 0 for c in cols} for m, cols in Q.NOT_NULL.items()}
    assert exchanges(Q.dq_report(models, figures)) < exchanges(Q.dq_report(models)) and exchanges(Q.dq_not_null(models, figures)) == 0
    assert exchanges(R.cohort_matrix(models["fct_cohort_retention"])) <= 6


def test_failing_rows(spark, models):
    broken = dict(models)
    broken["stg_products"] = models["stg_products"].limit(3).unionByName(models["stg_products"].limit(3)) \
        .withColumn("product_id", F.lit(5))
    assert Q.failing_rows(broken, "unique", "stg_products", "product_id").first().n_records == 6
    broken["dim_customers"] = models["dim_customers"].limit(0)
    orphans = Q.failing_rows(broken, "relationships", "fct_transactions", "customer_id").count()
    assert orphans == models["fct_transactions"].count() == Q.dq_relationships(broken).first().failures
    assert Q.failing_rows(models, "not_null", "stg_events", "event_id").count() == 0
    broken["stg_events"] = models["stg_events"].withColumn("event_type", F.lit("odd"))
    assert [r.event_type for r in Q.failing_rows(broken, "accepted_values", "stg_events", "event_type").collect()] == ["odd"]
