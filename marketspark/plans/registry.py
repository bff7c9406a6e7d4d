"""Named queries: every relation, report and data test as ``(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables under ``sf_dir``, derives the five raw
tables, and runs its model/report plan over all of it (lazily; the caller
acts).  Reports with multi-select filters run unfiltered, except the
``*_filtered`` queries, which apply the fixed selections below.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from marketspark.plans import quality as Q
from marketspark.plans import reports as R
from marketspark.plans.warehouse import INTERMEDIATE, MARTS, STAGING, build_models
from marketspark.sources.fixtures import TRANSACTION_TIE_BREAK, raw_from_driver

# Fixed selections for the filtered report queries.
CUSTOMER_SELECTION = {
    "loyalty_tier": ("gold", "platinum", "unknown"),
    "country": ("United States", "Germany", "fr"),
    "gender": ("female", "male"),
}
TRAFFIC_SELECTION = {"traffic_source": ("email", "organic", "unknown")}
PRODUCT_SELECTION = {
    "category": ("electronics", "home", "sports"),
    "brand": ("brand#1", "brand#12", "brand#13", "brand#2", "brand#21", "brand#25"),
}
CAMPAIGN_SELECTION = {
    "channel": ("email", "social", "display"),
    "objective": ("acquisition", "retention"),
}

Models = Mapping[str, DataFrame]


def models_for(spark: SparkSession, sf_dir: str) -> Models:
    """All 20 relations over the driver tables in ``sf_dir`` (lazy, built on access)."""
    return build_models(raw_from_driver(spark, sf_dir), {"transactions": TRANSACTION_TIE_BREAK})


def _customers(m: Models) -> DataFrame:
    return R.customers_named_country(m["fct_customer_metrics"])


def _campaign_tx(m: Models) -> DataFrame:
    return R.campaign_transactions(m["fct_transactions"], m["dim_campaigns"])


def _campaign_totals(m: Models) -> DataFrame:
    return R.campaign_totals(m["fct_transactions"], m["dim_campaigns"])


# Report name -> function of the model dict.
REPORTS: dict[str, Callable[[Models], DataFrame]] = {
    "kpi_overview": lambda m: R.kpi_overview(m["dim_customers"]),
    "customers_named_country": _customers,
    "filter_options": lambda m: R.filter_options(_customers(m), m["fct_traffic_conversion"],
                                                 m["fct_product_conversion"], m["dim_campaigns"]),
    "customers_filtered": lambda m: R.customers_filtered(_customers(m), **CUSTOMER_SELECTION),
    "customer_kpis": lambda m: R.customer_kpis(_customers(m)),
    "ltv_segment_counts": lambda m: R.ltv_segment_counts(_customers(m)),
    "loyalty_tier_counts": lambda m: R.loyalty_tier_counts(_customers(m)),
    "acquisition_mix": lambda m: R.acquisition_mix(_customers(m)),
    "revenue_by_acquisition": lambda m: R.revenue_by_acquisition(_customers(m)),
    "cohort_matrix": lambda m: R.cohort_matrix(m["fct_cohort_retention"]),
    "cohort_matrix_wide": lambda m: R.cohort_matrix_wide(m["fct_cohort_retention"]),
    "traffic_filtered": lambda m: R.traffic_filtered(m["fct_traffic_conversion"], **TRAFFIC_SELECTION),
    "traffic_monthly_filtered": lambda m: R.traffic_filtered(m["fct_traffic_monthly"], **TRAFFIC_SELECTION),
    "traffic_kpis": lambda m: R.traffic_kpis(m["fct_traffic_conversion"], m["agg_event_customers"]),
    "unique_event_customers": lambda m: R.unique_customers(m["agg_event_customers"]),
    "purchase_rate_by_source": lambda m: R.purchase_rate_by_source(m["fct_traffic_conversion"]),
    "bounce_rate_by_source": lambda m: R.bounce_rate_by_source(m["fct_traffic_conversion"]),
    "event_mix": lambda m: R.event_mix(m["fct_traffic_conversion"]),
    "monthly_volume": lambda m: R.monthly_volume(m["fct_traffic_monthly"]),
    "experiment_summary": lambda m: R.experiment_summary(m["fct_experiment_groups"]),
    "experiment_lift": lambda m: R.experiment_lift(m["fct_experiment_groups"]),
    "experiment_rates_long": lambda m: R.experiment_rates_long(m["fct_experiment_groups"]),
    "products_filtered": lambda m: R.products_filtered(m["fct_product_conversion"], **PRODUCT_SELECTION),
    "product_kpis": lambda m: R.product_kpis(m["fct_product_conversion"]),
    "revenue_by_category": lambda m: R.revenue_by_category(m["fct_product_conversion"]),
    "aov_by_category": lambda m: R.aov_by_category(m["fct_product_conversion"]),
    "top20_products": lambda m: R.top20_products(m["fct_product_conversion"]),
    "discount_by_category": lambda m: R.discount_by_category(m["fct_product_conversion"]),
    "price_vs_revenue": lambda m: R.price_vs_revenue(m["fct_product_conversion"]),
    "campaign_list": lambda m: R.campaign_list(m["dim_campaigns"]),
    "campaign_transactions": _campaign_tx,
    "campaigns_filtered": lambda m: R.campaigns_filtered(m["dim_campaigns"], **CAMPAIGN_SELECTION),
    "campaign_transactions_filtered": lambda m: R.campaigns_filtered(_campaign_tx(m), **CAMPAIGN_SELECTION),
    "campaign_kpis": lambda m: R.campaign_kpis(m["dim_campaigns"], _campaign_totals(m)),
    "revenue_by_channel": lambda m: R.revenue_by_channel(_campaign_totals(m)),
    "objective_mix": lambda m: R.objective_mix(m["dim_campaigns"]),
    "transactions_by_channel": lambda m: R.transactions_by_channel(_campaign_totals(m)),
    "segment_mix": lambda m: R.segment_mix(m["dim_campaigns"]),
    "uplift_vs_revenue": lambda m: R.uplift_vs_revenue(m["dim_campaigns"], _campaign_totals(m)),
}

QUALITY: dict[str, Callable[[Models], DataFrame]] = {
    "dq_not_null": Q.dq_not_null,
    "dq_unique": Q.dq_unique,
    "dq_accepted_values": Q.dq_accepted_values,
    "dq_relationships": Q.dq_relationships,
    "dq_report": Q.dq_report,
}


def _model_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: models_for(spark, sf_dir)[name]


def _derived_query(fn: Callable[[Models], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(models_for(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in (*STAGING, *INTERMEDIATE, *MARTS):
        out[name] = _model_query(name)
    for name, fn in {**REPORTS, **QUALITY}.items():
        out[name] = _derived_query(fn)
    return out
