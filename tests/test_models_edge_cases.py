"""Hand-made frames for cases the derived fixture does not cover."""

import datetime as dt

import pytest
from pyspark.sql.types import LongType

from marketspark.plans import intermediate as I
from marketspark.plans import marts as M
from marketspark.plans import quality as Q
from marketspark.plans import reports as R
from marketspark.plans import staging as S
from marketspark.plans.warehouse import build_models

T0 = dt.datetime(2021, 3, 10, 12, 0)


def ts(h=0, d=0):
    return T0 + dt.timedelta(hours=h, days=d)


def rows(df, *cols, order=None):
    sel = df.select(*cols) if cols else df
    out = [tuple(r) for r in sel.collect()]
    return sorted(out, key=repr) if order is None else out


def same(expected):
    return sorted(expected, key=repr)


# ------------------------------------------------------------------- staging

def test_customers_clean_and_unknown(raw_frames):
    c = raw_frames("customers", [
        {"customer_id": 1, "country": " US ", "gender": "Male ", "loyalty_tier": None, "acquisition_channel": ""},
        {"customer_id": 2, "country": "de", "gender": "female", "loyalty_tier": " Gold", "acquisition_channel": None},
    ])
    out = rows(S.stg_customers(c), "customer_id", "country", "gender", "loyalty_tier", "acquisition_channel")
    assert out == [(1, "us", "male", "unknown", ""), (2, "de", "female", "gold", "unknown")]


def test_event_dedupe_prefers_known_time_and_drops_null_session_first(raw_frames):
    e = raw_frames("events", [
        # id 1: NULL timestamp must lose against a known one (NULLs sort last).
        {"event_id": 1, "timestamp": None, "session_id": "a", "event_type": "view", "traffic_source": "Email"},
        {"event_id": 1, "timestamp": ts(2), "session_id": "a", "event_type": "click", "traffic_source": "Email"},
        # id 2: the earliest copy has no session -> removed before dedupe, so the later copy survives.
        {"event_id": 2, "timestamp": ts(0), "session_id": None, "event_type": "view"},
        {"event_id": 2, "timestamp": ts(5), "session_id": "b", "event_type": "purchase", "traffic_source": None},
    ])
    out = rows(S.stg_events(e), "event_id", "event_type", "traffic_source")
    assert out == [(1, "click", "email"), (2, "purchase", "unknown")]


def test_transaction_dedupe_tie_break_and_flags(raw_frames):
    t = raw_frames("transactions", [
        {"transaction_id": 7, "timestamp": ts(0), "quantity": 2.7, "gross_revenue": 5.0, "refund_flag": None,
         "l_partkey": 2},
        {"transaction_id": 7, "timestamp": ts(0), "quantity": 1.0, "gross_revenue": 9.0, "refund_flag": 1,
         "l_partkey": 1},
    ], extra={"l_partkey": LongType()})
    out = rows(S.stg_transactions(t, ["l_partkey"]), "transaction_id", "quantity", "gross_revenue", "is_refunded")
    assert out == [(7, 1, 9.0, True)]
    # Without the tie-break one of the two is kept.
    assert S.stg_transactions(t).count() == 1


def test_products_keep_earliest_launch(raw_frames):
    p = raw_frames("products", [
        {"product_id": 10, "category": "stale", "launch_date": dt.date(1996, 1, 1), "is_premium": "0"},
        {"product_id": 10, "category": " Home", "launch_date": dt.date(1994, 1, 1), "is_premium": "1"},
        {"product_id": 11, "category": "x", "launch_date": None, "is_premium": "true"},
        {"product_id": 11, "category": "y", "launch_date": dt.date(1999, 1, 1), "is_premium": "0"},
    ])
    out = rows(S.stg_products(p), "product_id", "category", "is_premium")
    assert out == [(10, "home", True), (11, "y", False)]


# -------------------------------------------------------------- intermediate

def _events(raw_frames, specs):
    return S.stg_events(raw_frames("events", [
        {"event_id": i, "timestamp": ts(i), "session_id": s, "customer_id": c, "product_id": p, "event_type": et,
         "traffic_source": src, "experiment_group": g}
        for i, (s, c, p, et, src, g) in enumerate(specs)]))


def test_funnel_steps_bounce_browse_and_null(raw_frames):
    ev = _events(raw_frames, [
        ("s", 1, 1, "view", "email", None), ("s", 1, 1, "bounce", "email", None),
        ("s", 1, 1, "browse", "email", None), ("s", 1, 1, None, "email", None),
    ])
    out = rows(I.int_funnel_steps(ev), "event_type", "funnel_step")
    assert out == [("browse", None), ("view", 1)]


def test_product_funnel_zero_views_is_null_rate(raw_frames):
    ev = _events(raw_frames, [("s", 1, 5, "click", "email", None), ("s", 1, 5, "add_to_cart", "email", None),
                              ("s", 1, 6, "browse", "email", None)])
    pf = I.int_product_funnel(I.int_funnel_steps(ev))
    out = rows(pf, "product_id", "views", "clicks", "view_to_click_pct", "click_to_cart_pct")
    assert out == [(5, 0, 1, None, 100.0), (6, 0, 0, None, None)]


def test_cart_activity_fans_out_per_purchase(raw_frames):
    ev = _events(raw_frames, [
        ("s1", 1, 9, "add_to_cart", "email", None),
        ("s1", 1, 9, "purchase", "email", None), ("s1", 1, 9, "purchase", "email", None),
        ("s2", 1, 9, "add_to_cart", "email", None),            # other session: no match
        ("s3", 1, None, "add_to_cart", "email", None),         # NULL product never matches
        ("s3", 1, None, "purchase", "email", None),
    ])
    out = rows(I.int_cart_activity(ev), "session_id", "was_purchased")
    assert out == [("s1", 1), ("s1", 1), ("s2", 0), ("s3", 0)]


def _tx(raw_frames, specs):
    return S.stg_transactions(raw_frames("transactions", [
        {"transaction_id": i, "timestamp": ts(d=i), "customer_id": c, "product_id": p, "quantity": 1.0,
         "discount_applied": 0.5, "gross_revenue": g, "campaign_id": camp, "refund_flag": f}
        for i, (c, p, g, camp, f) in enumerate(specs)]))


def test_customer_orders_refunds_and_refund_only_customer(raw_frames):
    tx = _tx(raw_frames, [
        (1, 1, 10.0, 3, 0), (1, 1, 20.01, 3, 1),   # partial refund still a valid purchase
        (1, 1, -7.5, 3, 1),                         # full refund
        (2, 1, -4.0, 3, 1),                         # refund-only customer: no row
        (3, None, 50.0, 0, 0), (3, 2, None, 0, 0),  # excluded rows
        (4, 2, 0.5, 0, 0),
    ])
    co = I.int_customer_orders(tx)
    out = rows(co, "customer_id", "total_orders", "total_revenue", "avg_order_value", "total_refund_count",
               "total_refund_value")
    assert out == [(1, 2, 30.01, 15.01, 1, 7.5), (4, 1, 0.5, 0.5, 0, 0.0)]


def test_customer_marts_has_purchased_and_segments(raw_frames):
    cust = S.stg_customers(raw_frames("customers", [
        {"customer_id": i, "signup_date": dt.date(2021, 1, 15)} for i in (1, 2, 4)]))
    tx = _tx(raw_frames, [(1, 1, 1000.0, 3, 0), (2, 1, -4.0, 3, 1), (4, 2, 0.5, 0, 0)])
    dim = M.dim_customers(cust, I.int_customer_orders(tx))
    fcm = M.fct_customer_metrics(dim)
    out = rows(fcm, "customer_id", "has_purchased", "total_orders", "total_revenue", "ltv_segment", "cohort_month")
    jan = dt.date(2021, 1, 1)
    assert out == [(1, 1, 1, 1000.0, "high", jan), (2, 0, 0, 0.0, "none", jan), (4, 1, 1, 0.5, "none", jan)]


def test_campaign_sentinel(raw_frames):
    camp = S.stg_campaigns(raw_frames("campaigns", [
        {"campaign_id": 0, "channel": "none"}, {"campaign_id": 5, "channel": " Email"}, {"campaign_id": None}]))
    assert rows(M.dim_campaigns(camp), "campaign_id", "channel") == [(5, "email")]
    tx = _tx(raw_frames, [(1, 1, 10.0, 0, 0), (1, 1, 12.0, 5, 0), (1, 1, 13.0, 99, 0)])
    facts = M.fct_transactions(tx)
    assert rows(facts, "campaign_id") == same([(5,), (99,), (None,)])
    ct = R.campaign_transactions(facts, M.dim_campaigns(camp))
    assert rows(ct, "campaign_id", "channel") == [(5, "email"), (99, None)]
    assert rows(R.revenue_by_channel(R.campaign_totals(facts, M.dim_campaigns(camp)))) == [("email", 12.0)]


def test_cohort_retention_matches_brute_force_with_duplicate_customer(spark, raw_frames):
    """Duplicate customer ids (different or equal cohorts) against the direct join formulation."""
    cust = S.stg_customers(raw_frames("customers", [
        {"customer_id": 1, "signup_date": dt.date(2021, 1, 3)},
        {"customer_id": 1, "signup_date": dt.date(2021, 1, 9)},   # same cohort twice
        {"customer_id": 2, "signup_date": dt.date(2021, 2, 1)},
        {"customer_id": 2, "signup_date": dt.date(2021, 5, 1)},   # two cohorts
        {"customer_id": 3, "signup_date": dt.date(2021, 6, 1)},   # no purchases
    ]))
    tx = _tx(raw_frames, [(1, 1, 10.0, 0, 0), (1, 1, 5.25, 0, 0), (2, 1, 7.0, 0, 0), (2, 2, 1.0, 0, 0)])
    cohorts, facts = I.int_customer_cohorts(cust), M.fct_transactions(tx)
    got = rows(M.fct_cohort_retention(cohorts, facts))
    cohorts.createOrReplaceTempView("t_cohorts")
    facts.createOrReplaceTempView("t_facts")
    want = rows(spark.sql("""
        SELECT c.cohort_month, trunc(CAST(t.transaction_timestamp AS DATE), 'month') AS order_month,
          CAST((year(trunc(CAST(t.transaction_timestamp AS DATE), 'month')) - year(c.cohort_month)) * 12
            + month(trunc(CAST(t.transaction_timestamp AS DATE), 'month')) - month(c.cohort_month) AS BIGINT)
            AS months_since_signup,
          COUNT(DISTINCT c.customer_id) AS active_customers, COUNT(DISTINCT t.transaction_id) AS total_orders,
          CAST(SUM(CAST(round(t.gross_revenue * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_revenue
        FROM t_cohorts c LEFT JOIN t_facts t ON c.customer_id = t.customer_id
        GROUP BY 1, 2, 3 HAVING months_since_signup >= 0"""))
    assert got == want and len(got) > 0


def test_traffic_and_experiment_marts(raw_frames):
    ev = _events(raw_frames, [
        ("s", 1, 1, "view", "email", "Control"), ("s", 2, 1, "purchase", "email", "control"),
        ("s", 1, 1, "bounce", None, "variant_a"), ("s", 1, 1, "view", None, None),
    ])
    conv = M.fct_traffic_conversion(ev)
    out = rows(conv, "traffic_source", "event_type", "event_count", "total_events", "pct_of_traffic_events")
    assert out == [("email", "purchase", 1, 2, 50.0), ("email", "view", 1, 2, 50.0),
                   ("unknown", "bounce", 1, 2, 50.0), ("unknown", "view", 1, 2, 50.0)]
    exp = rows(M.fct_experiment_groups(ev), "experiment_group", "total_views", "total_customers", "purchase_rate")
    assert exp == [("control", 1, 2, 100.0), ("variant_a", 0, 1, None)]
    lift = rows(R.experiment_lift(M.fct_experiment_groups(ev)), "experiment_group", "lift_pp")
    assert lift == [("control", 0.0), ("variant_a", None)]


# ------------------------------------------------------------------- reports

def test_report_orders_and_labels(spark):
    cust = spark.createDataFrame(
        [("high", "gold"), ("none", "unknown"), ("none", "bronze"), ("odd", "diamond")],
        "ltv_segment string, loyalty_tier string")
    assert rows(R.ltv_segment_counts(cust)) == same([(None, 1, None), ("High", 1, 0), ("None", 2, 3)])
    assert rows(R.loyalty_tier_counts(cust)) == same([(None, 1, None), (None, 1, None), ("bronze", 1, 3),
                                                      ("gold", 1, 1)])


def test_traffic_reports_keep_null_event_type_in_non_bounce(spark):
    conv = spark.createDataFrame(
        [("email", "purchase", 2), ("email", None, 6), ("email", "bounce", 2), ("organic", "view", 4)],
        "traffic_source string, event_type string, event_count bigint")
    assert rows(R.purchase_rate_by_source(conv)) == [("email", 2, 8, 25.0)]
    assert rows(R.bounce_rate_by_source(conv)) == [("email", 2, 10, 20.0)]


def test_empty_selection_kpis(spark, raw_frames):
    cust = spark.createDataFrame([], "has_purchased int, total_revenue double, total_orders bigint")
    r = R.customer_kpis(cust).first()
    assert (r.total_customers, r.total_purchasers, r.pct_converted, r.avg_ltv, r.total_revenue) == (0, 0, 0.0, None, 0.0)


def test_filters_and_top_k(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i % 7)) for i in range(1, 41)],
                               "product_id long, category string, total_revenue double")
    assert R.products_filtered(df.withColumn("brand", df.category), category=["a"], brand=None).count() == 20
    assert R.products_filtered(df.withColumn("brand", df.category), category=[], brand=[]).count() == 40
    top = df.withColumn("brand", df.category).withColumn("base_price", df.total_revenue)
    got = [r.product_id for r in R.top20_products(top, k=3).collect()]
    assert got == [6, 13, 20]  # revenue 6.0 ties broken by product_id


# ---------------------------------------------------------------- data tests

def test_quality_reports_failures(spark, raw_frames):
    raw = {
        "customers": raw_frames("customers", [{"customer_id": 1}, {"customer_id": 1}, {"customer_id": None}]),
        "campaigns": raw_frames("campaigns", [{"campaign_id": 1}]),
        "products": raw_frames("products", [{"product_id": 1}]),
        "events": raw_frames("events", [
            {"event_id": 1, "timestamp": ts(), "session_id": "s", "event_type": "weird"},
            {"event_id": 2, "timestamp": ts(), "session_id": "s", "event_type": "odd"}]),
        "transactions": raw_frames("transactions", [
            {"transaction_id": 1, "timestamp": ts(), "customer_id": 9, "product_id": 1, "gross_revenue": 3.0}]),
    }
    m = build_models(raw)
    rep = {(r.test, r.model, r.column_name): r.failures for r in Q.dq_report(m).collect()}
    assert len(rep) == 37
    assert rep[("unique", "stg_customers", "customer_id")] == 1
    assert rep[("not_null", "stg_customers", "customer_id")] == 1
    assert rep[("accepted_values", "stg_events", "event_type")] == 2
    assert rep[("relationships", "fct_transactions", "customer_id")] == 1
    assert rep[("unique", "dim_customers", "customer_id")] == 1


@pytest.mark.parametrize("n", [0])
def test_empty_inputs_build(raw_frames, n):
    raw = {t: raw_frames(t, []) for t in ("customers", "campaigns", "products", "events", "transactions")}
    m = build_models(raw)
    assert m["fct_cohort_retention"].count() == 0
    assert m["fct_experiment_groups"].count() == 0
    assert R.kpi_overview(m["dim_customers"]).first().total_customers == 0


def test_unique_event_customers_exact_and_approx(spark):
    ev = spark.range(0, 20000).selectExpr("id % 5000 AS customer_id")
    assert R.unique_event_customers(ev).first().unique_customers == 5000
    approx = R.unique_event_customers(ev, approx_rsd=0.02).first().unique_customers
    assert abs(approx - 5000) / 5000 < 0.08


def test_match_flag_join_large_fan_out_in_chunks(spark):
    from marketspark.operators import left_join_match_flag

    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    right = spark.range(0, 10000).selectExpr("CASE WHEN id < 9000 THEN 1 ELSE 2 END AS k")
    out = left_join_match_flag(left, right, ["k"], "hit", spread_by="v")
    got = {(r.k, r.hit): r.n for r in out.groupBy("k", "hit").count().withColumnRenamed("count", "n").collect()}
    assert got == {(1, 1): 9000, (2, 1): 1000, (3, 0): 1}
