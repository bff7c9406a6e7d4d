"""Hot keys: one customer / transaction id / cart key holds a third of all rows.

After running each operator, the per-reducer byte sizes of every shuffle are
read from AQE's map-output statistics.  Because rows are reduced map-side
(partial aggregation, partial dedupe limit, pre-aggregated join sides), no
reducer receives anything close to the hot key's third of the input.
"""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketspark.plans import intermediate as I
from marketspark.plans import marts as M
from marketspark.plans import staging as S
from marketspark.sources.raw import conform_raw

N = 60_000


def shuffle_stats(df) -> list[list[int]]:
    """Execute ``df``; return bytes per reduce partition for each shuffle stage."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()  # runs the adaptive plan in place; nothing is collected
    stats, stack = [], [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):  # stages are leaves; their subtree is .plan()
            if name == "ShuffleQueryStageExec":
                ms = node.mapStats()
                if ms.isDefined():
                    stats.append(list(ms.get().bytesByPartitionId()))
            stack.append(node.plan())
            continue
        children = node.children()
        for i in range(children.size()):
            stack.append(children.apply(i))
    return [s for s in stats if sum(s) > 0]


def max_share(stats: list[list[int]]) -> float:
    """Largest share of one reducer among the shuffles that carry real volume.

    Shuffles under 10% of the largest one (e.g. final aggregates over a few
    group keys, unevenly hashed by nature) are not what skew is about.
    """
    largest = max(sum(s) for s in stats)
    big = [s for s in stats if len(s) > 1 and sum(s) >= 0.1 * largest]
    return max(max(s) / sum(s) for s in big)


@pytest.fixture(scope="module")
def skewed_transactions(spark):
    hot = N // 3
    ids = spark.range(N).select(
        F.col("id"),
        F.when(F.col("id") < hot, F.lit(1)).otherwise(F.col("id") % 997 + 2).alias("customer_id"),
    )
    raw = ids.select(
        # A third of the rows are copies of one transaction id.
        F.when(F.col("id") < hot, F.lit(7)).otherwise(F.col("id") + 100).alias("transaction_id"),
        (F.lit(dt.datetime(2021, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % 400))
        .alias("timestamp"),
        F.col("customer_id"),
        (F.col("id") % 50 + 1).alias("product_id"),
        F.lit(1.0).alias("quantity"),
        F.lit(0.5).alias("discount_applied"),
        (F.col("id") % 900 / 10.0 + 1.0).alias("gross_revenue"),
        (F.col("id") % 5).alias("campaign_id"),
        F.lit(0.0).alias("refund_flag"),
    )
    return conform_raw("transactions", raw)


def test_dedupe_hot_id_is_limited_before_the_shuffle(skewed_transactions):
    stg = S.stg_transactions(skewed_transactions)
    stats = shuffle_stats(stg)
    assert stats and max_share(stats) < 0.25, stats
    assert stg.count() == N - N // 3 + 1


def test_hot_customer_aggregation_is_map_side(skewed_transactions):
    # Customer 1 owns a third of the rows (dedupe off: every row distinct).
    tx = skewed_transactions.withColumn("transaction_id", F.monotonically_increasing_id())
    orders = I.int_customer_orders(S.stg_transactions(tx).select("*"))
    stats = shuffle_stats(orders.select("customer_id", "total_orders"))
    assert max_share(stats) < 0.25, stats
    assert orders.where("customer_id = 1").first().total_orders == N // 3


def test_hot_customer_cohort_join_is_pre_aggregated(spark, skewed_transactions):
    tx = skewed_transactions.withColumn("transaction_id", F.monotonically_increasing_id())
    facts = M.fct_transactions(S.stg_transactions(tx))
    cohorts = I.int_customer_cohorts(S.stg_customers(conform_raw("customers", spark.range(1, 1000).select(
        F.col("id").alias("customer_id"), F.lit(dt.date(2020, 12, 5)).alias("signup_date")))))
    out = M.fct_cohort_retention(cohorts, facts)
    stats = shuffle_stats(out)
    assert max_share(stats) < 0.25, stats
    assert out.agg(F.sum("total_orders")).first()[0] == facts.where("customer_id < 1000").count()


def test_hot_cart_key_pre_aggregates_purchases(spark):
    hot = N // 3
    ev = spark.range(N).select(
        F.col("id").alias("event_id"),
        (F.lit(dt.datetime(2021, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % 400))
        .alias("timestamp"),
        F.when(F.col("id") < hot, F.lit(1)).otherwise(F.col("id") % 3000).alias("customer_id"),
        F.when(F.col("id") < hot, F.lit("s-hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 3000))
        .alias("session_id"),
        # The hot key has many purchases and three carts; other keys a mix.
        F.when(F.col("id") < 3, F.lit("add_to_cart")).when(F.col("id") < hot, F.lit("purchase"))
        .when(F.col("id") % 2 == 0, F.lit("add_to_cart")).otherwise(F.lit("purchase")).alias("event_type"),
        F.when(F.col("id") < hot, F.lit(5)).otherwise(F.col("id") % 3000).alias("product_id"),
    )
    stg = S.stg_events(conform_raw("events", ev))
    carts = I.int_cart_activity(stg)
    stats = shuffle_stats(carts)
    # The dedupe shuffle sees unique ids; the purchases side is one row per key.
    assert max_share(stats) < 0.25, stats
    assert carts.where("session_id = 's-hot'").count() == 3 * (hot - 3)


def test_the_measure_detects_a_naive_plan(skewed_transactions):
    """Control: shuffling raw rows by the hot key does put a third on one reducer."""
    naive = skewed_transactions.repartition(8, "customer_id").select("customer_id", "gross_revenue")
    assert max_share(shuffle_stats(naive)) > 0.3


def test_hot_campaign_left_join_is_split_by_aqe(spark, skewed_transactions):
    """Without a broadcast, the hot campaign's fact partition is split across tasks."""
    from marketspark.plans import reports as R

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        # Keep several map outputs: a skewed partition splits at map boundaries.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        tx = skewed_transactions.withColumn("transaction_id", F.monotonically_increasing_id()) \
            .withColumn("campaign_id", F.when(F.col("customer_id") == 1, F.lit(1)).otherwise(F.col("campaign_id")))
        facts = M.fct_transactions(S.stg_transactions(tx))
        dims = M.dim_campaigns(S.stg_campaigns(conform_raw("campaigns", spark.range(1, 6).select(
            F.col("id").alias("campaign_id"), F.lit("email").alias("channel")))))
        ct = R.campaign_transactions(facts, dims)
        plan = ct._jdf.queryExecution().executedPlan()
        plan.execute().count()
        assert "skew=true" in plan.toString()
        assert ct.where("campaign_id = 1").count() == facts.where("campaign_id = 1").count() >= N // 3
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
