"""Report queries (R1-R36) over the marts.

The dashboard finished its analysis in pandas on frames copied out of the
warehouse; here every report is one lazy plan from the mart scans to a small
result that stays distributed until the caller acts on it.  Multi-select
filters are keyword arguments (empty = no filter, several columns AND).

pandas semantics kept on purpose: group keys that are NULL are dropped,
``!= 'bounce'`` keeps NULL event types, an empty sum is 0, guarded rates are 0
on an empty selection, and a mean over no rows stays NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions import (
    capitalize,
    cents,
    exact_sum,
    exact_total,
    merged_sum,
    money_from_cents,
    month_label,
    not_equal_keep_null,
    pct,
    pct_or_zero,
    round_half_away,
    share_pct,
)
from marketspark.operators import isin_filters, merged_distinct, pivot_sum, top_k, unpivot_long

Selection = Iterable[str] | None

# Display names of ISO country codes (unmapped codes keep their code).
COUNTRY_NAMES = {
    "au": "Australia",
    "br": "Brazil",
    "ca": "Canada",
    "de": "Germany",
    "in": "India",
    "uk": "United Kingdom",
    "us": "United States",
}

# Display order of LTV segments and loyalty tiers.
LTV_ORDER = ("High", "Mid", "Low", "None")
LOYALTY_ORDER = ("platinum", "gold", "silver", "bronze")

# Experiment rate columns and their labels, in display order.
EXPERIMENT_RATES = (
    ("click_rate", "Click Rate"),
    ("add_to_cart_rate", "Add to Cart Rate"),
    ("purchase_rate", "Purchase Rate"),
    ("bounce_rate", "Bounce Rate"),
)


def _money_total(c: str) -> Column:
    """pandas ``sum`` of a money column, exact in cents; 0 for no rows."""
    return F.coalesce(money_from_cents(F.sum(cents(c))), F.lit(0.0))


def _money_mean(c: str, where: Column | None = None) -> Column:
    """pandas ``mean`` of a money column (optionally of the rows ``where`` holds).

    Exact: cents total / count, with one final division; NULL for no rows.
    """
    value = F.col(c) if where is None else F.when(where, F.col(c))
    return F.try_divide(F.sum(cents(value)).cast("double"), F.count(value).cast("double")) / F.lit(100.0)


def _ascending(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """Rows by ``value``, NULLs last, then by ``ties``."""
    return df.orderBy(F.col(value).asc_nulls_last(), *ties)


def _order_index(c: Column, order: Sequence[str]) -> Column:
    idx = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(order))):
        idx = F.when(c == v, F.lit(i)).otherwise(idx)
    return idx


# ------------------------------------------------------------- landing page

def kpi_overview(dim_customers: DataFrame) -> DataFrame:
    """Customer count, purchasers, conversion %, average LTV and orders, revenue."""
    purchasers = F.sum(F.when(F.col("has_purchased") == 1, 1).otherwise(0))
    customers = F.countDistinct("customer_id")
    return dim_customers.agg(
        customers.alias("total_customers"),
        purchasers.alias("total_purchasers"),
        round_half_away(pct(purchasers, customers), 1).alias("pct_converted"),
        # AVG over customers with revenue > 0, rounded to cents.
        (F.round(F.try_divide(F.sum(F.when(F.col("total_revenue") > 0, cents("total_revenue"))).cast("double"),
                              F.count(F.when(F.col("total_revenue") > 0, 1)).cast("double")), 0)
         / F.lit(100.0)).alias("avg_ltv"),
        round_half_away(F.avg(F.when(F.col("total_orders") > 0, F.col("total_orders"))), 1).alias("avg_orders"),
        money_from_cents(F.sum(cents("total_revenue"))).alias("total_revenue"),
    )


# --------------------------------------------------------- customer overview

def customers_named_country(fct_customer_metrics: DataFrame) -> DataFrame:
    """R2: customer metrics with country codes replaced by display names."""
    c = F.col("country")
    named = c
    for code, name in reversed(list(COUNTRY_NAMES.items())):
        named = F.when(c == code, F.lit(name)).otherwise(named)
    return fct_customer_metrics.withColumn("country", named)


def filter_options(customers: DataFrame, traffic_conversion: DataFrame, product_conversion: DataFrame,
                   campaigns: DataFrame) -> DataFrame:
    """Sorted distinct non-NULL values of every filterable column, as (filter_name, value)."""
    sources = [
        (customers, ("loyalty_tier", "country", "gender")),
        (traffic_conversion, ("traffic_source",)),
        (product_conversion, ("category", "brand")),
        (campaigns, ("channel", "objective", "target_segment")),
    ]
    parts = []
    for df, cols in sources:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
            [], list(cols), "filter_name", "value")
        parts.append(long)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value").isNotNull()).distinct().orderBy("filter_name", "value")


def customers_filtered(customers: DataFrame, loyalty_tier: Selection = None, country: Selection = None,
                       gender: Selection = None) -> DataFrame:
    """Customers matching the tier / country / gender selections."""
    return isin_filters(customers, loyalty_tier=loyalty_tier, country=country, gender=gender)


def customer_kpis(customers: DataFrame) -> DataFrame:
    """KPI row of the (filtered) customer frame."""
    n = F.count(F.lit(1))
    purchasers = F.coalesce(F.sum("has_purchased"), F.lit(0).cast("bigint"))
    return customers.agg(
        n.alias("total_customers"),
        purchasers.alias("total_purchasers"),
        pct_or_zero(purchasers, n).alias("pct_converted"),
        _money_mean("total_revenue", F.col("total_revenue") > 0).alias("avg_ltv"),
        F.avg(F.when(F.col("total_orders") > 0, F.col("total_orders"))).alias("avg_orders"),
        _money_total("total_revenue").alias("total_revenue"),
    )


def ltv_segment_counts(customers: DataFrame) -> DataFrame:
    """Customers per LTV segment, labelled High/Mid/Low/None with a display order."""
    g = customers.where(F.col("ltv_segment").isNotNull()).groupBy("ltv_segment").agg(
        F.count(F.lit(1)).alias("customers"))
    label = capitalize("ltv_segment")
    order = _order_index(label, LTV_ORDER)
    return g.select(F.when(order.isNotNull(), label).alias("ltv_segment"), "customers",
                    order.alias("display_order"))


def loyalty_tier_counts(customers: DataFrame) -> DataFrame:
    """Customers per loyalty tier in platinum..bronze order; other tiers get a NULL label, last."""
    g = customers.where(F.col("loyalty_tier").isNotNull()).groupBy("loyalty_tier").agg(
        F.count(F.lit(1)).alias("customers"))
    order = _order_index(F.col("loyalty_tier"), LOYALTY_ORDER)
    return g.select(F.when(order.isNotNull(), F.col("loyalty_tier")).alias("loyalty_tier"), "customers",
                    order.alias("display_order"))


def acquisition_mix(customers: DataFrame) -> DataFrame:
    """Customers per acquisition channel and their share of all counted customers (%)."""
    src = customers.where(F.col("acquisition_channel").isNotNull())
    g = src.groupBy("acquisition_channel").agg(F.count(F.lit(1)).alias("customers"))
    # The total is a scalar subquery over the grouped rows (one value, no join or
    # global window); it shares the grouping's shuffle instead of rescanning.
    total = g.agg(F.sum("customers")).scalar()
    return g.withColumn("share_pct", share_pct("customers", total))


def revenue_by_acquisition(customers: DataFrame) -> DataFrame:
    """Gross revenue per acquisition channel, ascending."""
    return _ascending(customers.where(F.col("acquisition_channel").isNotNull()).groupBy("acquisition_channel").agg(
        _money_total("total_revenue").alias("total_revenue")), "total_revenue", "acquisition_channel")


def cohort_matrix(fct_cohort_retention: DataFrame) -> DataFrame:
    """A row per cohort month (yyyy-MM) and month offset present, revenue summed, gaps 0.

    The cells of the page's pivot in long form: its columns are the offsets in
    the data, however many there are.  ``cohort_matrix_wide`` spreads them.
    """
    cells = fct_cohort_retention.where(F.col("cohort_month").isNotNull() & F.col("months_since_signup").isNotNull()).groupBy(
        month_label("cohort_month").alias("cohort_month"), "months_since_signup").agg(F.sum(cents("total_revenue")).alias("__cents"))
    # One row holds the cells, at most calendar months squared, so that the facts are grouped once.
    one = cells.agg(F.collect_set("cohort_month").alias("months"), F.collect_set("months_since_signup").alias("offsets"),
                    F.map_from_entries(F.collect_list(F.struct(F.struct("cohort_month", "months_since_signup").alias("cell"), "__cents")))
                    .alias("held"))
    grid = one.select("offsets", "held", F.explode("months").alias("cohort_month")).select(
        "held", "cohort_month", F.explode("offsets").alias("months_since_signup"))
    return grid.select("cohort_month", "months_since_signup", F.coalesce(
        money_from_cents(F.try_element_at("held", F.struct("cohort_month", "months_since_signup"))), F.lit(0.0)).alias("total_revenue"))


def cohort_matrix_wide(fct_cohort_retention: DataFrame, months: Sequence[int] | None = None) -> DataFrame:
    """R10 as a pivot: columns ``M<offset>`` of the offsets present (or of ``months``, to choose some)."""
    src = fct_cohort_retention.select(month_label("cohort_month").alias("cohort_month"),
                                      "months_since_signup", cents("total_revenue").alias("revenue_cents"))
    wide = pivot_sum(src, "cohort_month", "months_since_signup", "revenue_cents", months, fill=0,
                     label=lambda v: f"M{v}")
    return wide.select("cohort_month", *[(F.col(c).cast("double") / F.lit(100.0)).alias(c)
                                         for c in wide.columns if c != "cohort_month"])


# ------------------------------------------------------ traffic & conversion

def traffic_filtered(traffic: DataFrame, traffic_source: Selection = None) -> DataFrame:
    """A traffic mart (conversion or monthly) restricted to the selected sources."""
    return isin_filters(traffic, traffic_source=traffic_source)


def unique_event_customers(stg_events: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """Distinct customers with any event (ignores the source filter).

    Exact by default (partial distinct per task, then one shuffle on the
    customer key).  ``approx_rsd`` switches to a HyperLogLog++ sketch with
    that relative standard deviation: fixed-size partial state per task and
    no shuffle of customer keys, for dashboards over very large event tables.
    """
    if approx_rsd is not None:
        return stg_events.agg(F.approx_count_distinct("customer_id", approx_rsd).alias("unique_customers"))
    return stg_events.agg(F.countDistinct("customer_id").alias("unique_customers"))


def unique_customers(event_customers: DataFrame) -> DataFrame:
    """R13 from the written states of ``marts.agg_event_customers``: no event row is read."""
    return merged_distinct(event_customers, [], "unique_customers")


def traffic_kpis(conversion: DataFrame, event_customers: DataFrame) -> DataFrame:
    """Total events, unique customers, purchase rate over non-bounce events, bounce rate."""
    et = F.col("event_type")
    total = F.coalesce(F.sum("event_count"), F.lit(0).cast("bigint"))
    purchases = F.coalesce(F.sum(F.when(et == "purchase", F.col("event_count"))), F.lit(0).cast("bigint"))
    bounces = F.coalesce(F.sum(F.when(et == "bounce", F.col("event_count"))), F.lit(0).cast("bigint"))
    non_bounce = F.coalesce(F.sum(F.when(not_equal_keep_null(et, "bounce"), F.col("event_count"))),
                            F.lit(0).cast("bigint"))
    unique = unique_customers(event_customers).scalar()
    return conversion.agg(
        total.alias("total_events"),
        pct_or_zero(purchases, non_bounce).alias("purchase_rate"),
        pct_or_zero(bounces, total).alias("bounce_rate"),
    ).select("total_events", unique.alias("unique_customers"), "purchase_rate", "bounce_rate")


def _rate_by_source(conversion: DataFrame, event_type: str, over_non_bounce: bool) -> DataFrame:
    et = F.col("event_type")
    base = F.when(not_equal_keep_null(et, "bounce"), F.col("event_count")) if over_non_bounce \
        else F.col("event_count")
    g = conversion.where(F.col("traffic_source").isNotNull()).groupBy("traffic_source").agg(
        F.count_if(et == event_type).alias("__rows"),
        F.sum(F.when(et == event_type, F.col("event_count"))).alias("event_count"),
        F.sum(base).alias("total"),
    )
    # Inner merge: only sources that have a row of this event type.
    return _ascending(g.where(F.col("__rows") > 0).select(
        "traffic_source", "event_count", "total", share_pct("event_count", "total").alias("rate")), "rate", "traffic_source")


def purchase_rate_by_source(conversion: DataFrame) -> DataFrame:
    """Purchases / non-bounce events per source (%), ascending."""
    return _rate_by_source(conversion, "purchase", over_non_bounce=True)


def bounce_rate_by_source(conversion: DataFrame) -> DataFrame:
    """Bounces / all events per source (%), ascending."""
    return _rate_by_source(conversion, "bounce", over_non_bounce=False)


def event_mix(conversion: DataFrame, event_types: Sequence[str] | None = None) -> DataFrame:
    """Traffic source x event type, event counts summed, gaps 0.

    Without ``event_types`` the columns are the event types present (Spark
    collects the distinct values of that small categorical column first).
    """
    return pivot_sum(conversion, "traffic_source", "event_type", "event_count", event_types, fill=0)


def monthly_volume(monthly: DataFrame) -> DataFrame:
    """Events per (yyyy-MM, source), by source and month."""
    return monthly.where(F.col("traffic_source").isNotNull() & F.col("event_month").isNotNull()).groupBy(
        month_label("event_month").alias("event_month"), "traffic_source",
    ).agg(F.sum("event_count").alias("event_count")).orderBy("traffic_source", "event_month")


def experiment_summary(fct_experiment_groups: DataFrame) -> DataFrame:
    """The experiment mart ordered by group."""
    return fct_experiment_groups.orderBy("experiment_group")


def experiment_lift(fct_experiment_groups: DataFrame, control: str = "control") -> DataFrame:
    """Purchase-rate difference of each group vs the control group, in points.

    The control rate is a scalar subquery over the (one row per group) mart:
    a single value, no join.
    """
    control_rate = fct_experiment_groups.where(F.col("experiment_group") == control) \
        .select("purchase_rate").scalar()
    with_control = fct_experiment_groups.select(
        "experiment_group", "purchase_rate", control_rate.alias("control_purchase_rate"))
    return with_control.withColumn(
        "lift_pp", round_half_away(F.col("purchase_rate") - F.col("control_purchase_rate"), 2))


def experiment_rates_long(fct_experiment_groups: DataFrame) -> DataFrame:
    """The four rates per group as (experiment_group, metric, label, value) rows."""
    long = unpivot_long(fct_experiment_groups, ["experiment_group"], [c for c, _ in EXPERIMENT_RATES],
                        "metric", "value")
    label = F.lit(None).cast("string")
    for c, lab in reversed(EXPERIMENT_RATES):
        label = F.when(F.col("metric") == c, F.lit(lab)).otherwise(label)
    return long.select("experiment_group", "metric", label.alias("label"), "value")


# ------------------------------------------------------- product performance

def products_filtered(products: DataFrame, category: Selection = None, brand: Selection = None) -> DataFrame:
    """Products matching the category / brand selections."""
    return isin_filters(products, category=category, brand=brand)


def product_kpis(products: DataFrame) -> DataFrame:
    """Product KPIs (buyers are a sum of per-product distinct counts, as on the page)."""
    zero = F.lit(0).cast("bigint")
    return products.agg(
        F.countDistinct("product_id").alias("total_products"),
        _money_total("total_revenue").alias("total_revenue"),
        F.coalesce(F.sum("total_transactions"), zero).alias("total_transactions"),
        F.coalesce(F.sum("unique_buyers"), zero).alias("total_buyers"),
        _money_mean("avg_order_value", F.col("avg_order_value") > 0).alias("avg_order_value"),
        _money_total("total_discount").alias("total_discount"),
    )


def revenue_by_category(products: DataFrame) -> DataFrame:
    """Revenue per category, ascending."""
    return _ascending(products.where(F.col("category").isNotNull()).groupBy("category").agg(
        _money_total("total_revenue").alias("total_revenue")), "total_revenue", "category")


def aov_by_category(products: DataFrame) -> DataFrame:
    """Unweighted mean of product average order value per category (zeros included), ascending."""
    return _ascending(products.where(F.col("category").isNotNull()).groupBy("category").agg(
        _money_mean("avg_order_value").alias("avg_order_value")), "avg_order_value", "category")


def top20_products(products: DataFrame, k: int = 20) -> DataFrame:
    """The k products with the highest revenue (> 0); ties broken by product_id; shown ascending."""
    src = products.where(F.col("total_revenue") > 0).select(
        "product_id", "category", "brand", "base_price", "total_revenue")
    return _ascending(top_k(src, k, [F.col("total_revenue").desc(), F.col("product_id").asc()]), "total_revenue", "product_id")


def discount_by_category(products: DataFrame) -> DataFrame:
    """Discount total per category, ascending."""
    return _ascending(products.where(F.col("category").isNotNull()).groupBy("category").agg(
        _money_total("total_discount").alias("total_discount")), "total_discount", "category")


def price_vs_revenue(products: DataFrame) -> DataFrame:
    """One point per product with revenue: (category, product_id, base_price, total_revenue)."""
    return products.where(F.col("total_revenue") > 0).select(
        "category", "product_id", "base_price", "total_revenue")


# ------------------------------------------------------------------ campaigns

def campaign_list(dim_campaigns: DataFrame) -> DataFrame:
    """The campaign dimension."""
    return dim_campaigns


def campaign_transactions(fct_transactions: DataFrame, dim_campaigns: DataFrame) -> DataFrame:
    """Attributed transactions with their campaign attributes (NULL if unmatched).

    No broadcast hint: the planner broadcasts the campaign side only when its
    measured size is under the broadcast threshold (AQE re-checks at run
    time) and falls back to a sort-merge join otherwise.
    """
    t = fct_transactions.where(F.col("campaign_id").isNotNull() & (F.col("gross_revenue") > 0)).select(
        "campaign_id", "gross_revenue", "is_refunded")
    c = dim_campaigns.select("campaign_id", "channel", "objective", "target_segment", "expected_uplift")
    return t.join(c, "campaign_id", "left")


def campaigns_filtered(frame: DataFrame, channel: Selection = None, objective: Selection = None,
                       target_segment: Selection = None) -> DataFrame:
    """Campaigns or attributed transactions matching the selections."""
    return isin_filters(frame, channel=channel, objective=objective, target_segment=target_segment)


def campaign_totals(fct_transactions: DataFrame, dim_campaigns: DataFrame, channel: Selection = None,
                    objective: Selection = None, target_segment: Selection = None) -> DataFrame:
    """Attributed transactions reduced per campaign, with the campaign's attributes (NULL if unmatched).

    Facts are aggregated by campaign before the join, so no fact row is joined;
    a selection (R30) is applied to the dimension first.  Columns: campaign_id,
    channel, objective, target_segment, expected_uplift, revenue (exact),
    transactions, flagged (rows with a refund flag), refunded.
    """
    t = fct_transactions.where(F.col("campaign_id").isNotNull() & (F.col("gross_revenue") > 0)).groupBy("campaign_id").agg(
        exact_sum("gross_revenue").alias("revenue"), F.count(F.lit(1)).alias("transactions"),
        F.count("is_refunded").alias("flagged"), F.count_if("is_refunded").alias("refunded"))
    c = campaigns_filtered(dim_campaigns, channel, objective, target_segment).select(
        "campaign_id", "channel", "objective", "target_segment", "expected_uplift")
    selected = any(s for s in (channel, objective, target_segment))
    return t.join(c, "campaign_id", "inner" if selected else "left")


def _exact_total(c: str) -> Column:
    """Sum of exact money as a double; 0 for no rows."""
    return F.coalesce(exact_total(merged_sum(c)), F.lit(0.0))


def campaign_kpis(campaigns: DataFrame, totals: DataFrame) -> DataFrame:
    """Campaign KPIs (refund rate counts partial refunds only: full ones are not in the facts)."""
    # One pass over the campaign totals for all three figures: a single scalar
    # subquery returning a struct, bound to one column and then unpacked.
    tx = totals.agg(F.struct(
        _exact_total("revenue").alias("revenue"),
        F.coalesce(F.sum("transactions"), F.lit(0).cast("bigint")).alias("n"),
        pct_or_zero(F.sum("refunded"), F.sum("flagged")).alias("refund_rate"),
    )).scalar()
    uplift = F.try_divide(exact_total(exact_sum("expected_uplift")), F.count("expected_uplift").cast("double"))
    return campaigns.agg(
        F.countDistinct("campaign_id").alias("total_campaigns"),
        F.countDistinct("channel").alias("total_channels"),
        (uplift * F.lit(100.0)).alias("avg_expected_uplift"),
    ).select("*", tx.alias("__tx")).select(
        "total_campaigns", "total_channels",
        F.col("__tx.revenue").alias("total_attributed_revenue"),
        F.col("__tx.n").alias("total_transactions"),
        "avg_expected_uplift",
        F.col("__tx.refund_rate").alias("refund_rate"),
    )


def revenue_by_channel(totals: DataFrame) -> DataFrame:
    """Attributed revenue per channel, ascending (unmatched, NULL channel dropped)."""
    return _ascending(totals.where(F.col("channel").isNotNull()).groupBy("channel").agg(
        _exact_total("revenue").alias("gross_revenue")), "gross_revenue", "channel")


def _distinct_campaign_mix(campaigns: DataFrame, key: str) -> DataFrame:
    src = campaigns.where(F.col(key).isNotNull())
    g = src.groupBy(key).agg(F.countDistinct("campaign_id").alias("campaigns"))
    total = g.agg(F.sum("campaigns")).scalar()
    return g.withColumn("share_pct", share_pct("campaigns", total))


def objective_mix(campaigns: DataFrame) -> DataFrame:
    """Distinct campaigns per objective and share (%)."""
    return _distinct_campaign_mix(campaigns, "objective")


def transactions_by_channel(totals: DataFrame) -> DataFrame:
    """Attributed transactions per channel, ascending."""
    return _ascending(totals.where(F.col("channel").isNotNull()).groupBy("channel").agg(
        F.sum("transactions").alias("transactions")), "transactions", "channel")


def segment_mix(campaigns: DataFrame) -> DataFrame:
    """Distinct campaigns per target segment and share (%)."""
    return _distinct_campaign_mix(campaigns, "target_segment")


def uplift_vs_revenue(campaigns: DataFrame, totals: DataFrame) -> DataFrame:
    """Per campaign, expected uplift (%) against attributed revenue.

    Campaigns without attributed revenue or uplift drop out (the page's
    left merge + dropna), so the join is inner and of campaign rows only.
    """
    rev = totals.groupBy("campaign_id").agg(_exact_total("revenue").alias("attributed_revenue"))
    c = campaigns.where(F.col("expected_uplift").isNotNull()).select(
        "campaign_id", "channel", "objective", "target_segment", "expected_uplift")
    return c.join(rev, "campaign_id", "inner").select(
        "campaign_id", "channel", "objective", "target_segment", "expected_uplift",
        (F.col("expected_uplift") * F.lit(100.0)).alias("uplift_pct"), "attributed_revenue")
