"""Physical-plan shape: the properties the design relies on at scale."""

import os
import re
import tempfile

import pytest

from marketspark.plans.registry import all_queries
from marketspark.plans import reports as R
from marketspark.plans.warehouse import build_all
from marketspark.sources import raw_from_driver, read_raw
from marketspark.sources.fixtures import TRANSACTION_TIE_BREAK

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan(q(spark, SF)) for k, q in all_queries().items()}


def test_no_pairwise_joins_and_no_python(plans):
    for key, p in plans.items():
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                    "PythonUDF", "FlatMapGroupsInPandas"):
            assert bad not in p, (key, bad)


def _operators(p: str) -> list[tuple[int, str, str]]:
    """(id, operator, Arguments line) from the detail sections of a formatted plan."""
    out = []
    for block in re.split(r"\n\n(?=\(\d+\) )", p):
        m = re.match(r"\((\d+)\) (\w+)", block)
        if m:
            args = re.search(r"^Arguments: (.*)$", block, re.M)
            out.append((int(m.group(1)), m.group(2), args.group(1) if args else ""))
    return out


def test_dedupe_limits_before_the_shuffle(plans):
    """Partial WindowGroupLimit below the dedupe-key Exchange, Final above it.

    Formatted plans number children below their parents, so the ids must
    increase Partial < Exchange < Final.
    """
    for key, id_col in (("stg_events", "event_id"), ("stg_transactions", "transaction_id"),
                        ("stg_products", "product_id")):
        ops = _operators(plans[key])
        partial = [i for i, op, a in ops if op == "WindowGroupLimit" and a.endswith("Partial")]
        final = [i for i, op, a in ops if op == "WindowGroupLimit" and a.endswith("Final")]
        shuffle = [i for i, op, a in ops if op == "Exchange" and a.startswith(f"hashpartitioning({id_col}#")]
        assert partial and final and shuffle, (key, ops)
        assert any(p < e < f for p in partial for e in shuffle for f in final), (key, partial, shuffle, final)


def test_aggregations_are_partial_before_shuffle(plans):
    for key in ("int_customer_orders", "fct_experiment_groups", "fct_traffic_conversion", "product_kpis"):
        p = plans[key]
        assert re.search(r"partial_(count|sum|min|max)", p), key


def test_scan_pushdown_and_pruning(spark):
    root = tempfile.mkdtemp(prefix="marketspark-plan-")
    raw = raw_from_driver(spark, SF)
    raw["events"].write.parquet(os.path.join(root, "seeds", "events.parquet"))
    events = read_raw(spark, os.path.join(root, "seeds"), fmt="parquet", tables=("events",))["events"]
    from marketspark.plans.staging import stg_events
    p = plan(stg_events(events))
    assert "PushedFilters: [IsNotNull(session_id)]" in p

    marts = build_all(spark, raw, os.path.join(root, "warehouse"), {"transactions": TRANSACTION_TIE_BREAK})
    p = plan(R.revenue_by_category(R.products_filtered(marts["fct_product_conversion"],
                                                       category=["home", "sports"])))
    assert re.search(r"PushedFilters: \[.*In\(category, \[home,sports\]\)", p), p
    assert "ReadSchema: struct<category:string,total_revenue:double>" in p


# Shuffles per model over written staging tables with broadcasts disabled (the
# large-data plan); the README table documents the same numbers.  Two of the five
# of int_cart_activity bring one frequent-key sketch per task together.
EXPECTED_EXCHANGES = {
    "int_customer_orders": 1, "int_product_funnel": 1, "int_cart_activity": 5,
    "dim_customers": 2, "dim_products": 2, "fct_cohort_retention": 5, "fct_traffic_conversion": 3,
    "fct_traffic_monthly": 2, "fct_experiment_groups": 2, "fct_transactions": 0, "dim_campaigns": 0,
}


def test_shuffle_counts_at_scale(spark):
    from marketspark.plans.warehouse import downstream_models, staging_models
    from marketspark.sources import materialise

    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    try:
        root = tempfile.mkdtemp(prefix="marketspark-shuffles-")
        stg = staging_models(raw_from_driver(spark, SF), {"transactions": TRANSACTION_TIE_BREAK})
        for n in ("stg_events", "stg_transactions"):
            stg[n] = materialise(spark, stg[n], root, n)
        m = downstream_models(stg)
        for name, expected in EXPECTED_EXCHANGES.items():
            p = m[name]._jdf.queryExecution().executedPlan().toString()
            got = len(re.findall(r"Exchange (hashpartitioning|SinglePartition|rangepartitioning)", p))
            assert got == expected, (name, got, p)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
