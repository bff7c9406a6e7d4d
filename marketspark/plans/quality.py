"""Data tests (Q1-Q5): the 37 declared column tests as Spark jobs.

Each test yields its failing rows (see ``operators.quality``); the report
functions count them into ``(test, model, column_name, failures)`` rows.  The
NULL checks of one model share a single aggregation pass.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.operators import (
    accepted_values_failures,
    column_tests,
    not_null_failures,
    null_counts,
    orphan_count,
    relationships_failures,
    unique_failures,
)

# The declared tests, by model.  The staging test declared on
# stg_customers.traffic_source (a column that model does not have) is applied
# to its acquisition_channel.
NOT_NULL = {
    "stg_customers": ("customer_id", "loyalty_tier", "acquisition_channel"),
    "stg_campaigns": ("campaign_id",),
    "stg_products": ("product_id",),
    "stg_events": ("event_id", "session_id"),
    "stg_transactions": ("transaction_id",),
    "dim_customers": ("customer_id",),
    "dim_products": ("product_id",),
    "dim_campaigns": ("campaign_id",),
    "fct_transactions": ("transaction_id", "customer_id", "product_id"),
    "fct_customer_metrics": ("customer_id",),
    "fct_product_conversion": ("product_id",),
    "fct_cohort_retention": ("cohort_month",),
    "fct_traffic_conversion": ("traffic_source", "event_type"),
    "fct_traffic_monthly": ("traffic_source", "event_month"),
    "fct_experiment_groups": ("experiment_group", "purchase_rate"),
}
UNIQUE = {
    "stg_customers": "customer_id",
    "stg_campaigns": "campaign_id",
    "stg_products": "product_id",
    "stg_events": "event_id",
    "stg_transactions": "transaction_id",
    "dim_customers": "customer_id",
    "dim_products": "product_id",
    "dim_campaigns": "campaign_id",
    "fct_transactions": "transaction_id",
    "fct_customer_metrics": "customer_id",
    "fct_product_conversion": "product_id",
    "fct_experiment_groups": "experiment_group",
}
ACCEPTED_VALUES = {
    ("stg_events", "event_type"): ("browse", "click", "add_to_cart", "purchase", "view", "bounce"),
}
RELATIONSHIPS = {
    ("fct_transactions", "customer_id"): ("dim_customers", "customer_id"),
}


#: By model, what was observed while it was written.
Figures = Mapping[str, Mapping] | None


def _row(test: str, model: str, column: str, failures) -> DataFrame:
    return failures.select(F.lit(test).alias("test"), F.lit(model).alias("model"),
                           F.lit(column).alias("column_name"), F.col("failures").cast("bigint").alias("failures"))


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("failures"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def observed_figures(model: str) -> dict[str, Column]:
    """Aggregates to observe while a model is written: the NULL count of each not-NULL-tested column."""
    return {f"nulls:{c}": F.count_if(F.col(c).isNull()) for c in NOT_NULL.get(model, ())}


def _known_nulls(model: str, figures: Figures) -> dict[str, int] | None:
    """NULL counts of all tested columns of a model, if they were observed when it was written."""
    seen = (figures or {}).get(model, {})
    known = {c: seen[f"nulls:{c}"] for c in NOT_NULL[model] if f"nulls:{c}" in seen}
    return known if len(known) == len(NOT_NULL[model]) else None


def _stated(models: Mapping[str, DataFrame], model: str, known: Mapping[str, int]) -> DataFrame:
    """not_null rows of a model from known counts: one literal row set, no table is read."""
    rows = F.array(*[F.struct(F.lit("not_null").alias("test"), F.lit(model).alias("model"), F.lit(c).alias("column_name"),
                              F.lit(n).cast("bigint").alias("failures")) for c, n in known.items()])
    return models[model].sparkSession.range(1).select(F.inline(rows))


def dq_not_null(models: Mapping[str, DataFrame], figures: Figures = None) -> DataFrame:
    """Q1: NULL count of every not-NULL-tested column.

    ``figures`` are those observed while the models were written (``warehouse.written_figures``);
    models without them are read, in one pass each.
    """
    parts = []
    for model, cols in NOT_NULL.items():
        if (known := _known_nulls(model, figures)) is not None:
            parts.append(_stated(models, model, known))
            continue
        counts = null_counts(models[model], cols)
        parts.append(counts.select(F.lit("not_null").alias("test"), F.lit(model).alias("model"),
                                   "column_name", F.col("failures").cast("bigint").alias("failures")))
    return _union(parts)


def dq_unique(models: Mapping[str, DataFrame]) -> DataFrame:
    """Q2: number of non-NULL values occurring more than once, per unique-tested column."""
    return _union([_row("unique", m, c, _count(unique_failures(models[m], c))) for m, c in UNIQUE.items()])


def dq_accepted_values(models: Mapping[str, DataFrame]) -> DataFrame:
    """Q3: number of distinct non-NULL values outside the accepted list."""
    return _union([_row("accepted_values", m, c, _count(accepted_values_failures(models[m], c, vals)))
                   for (m, c), vals in ACCEPTED_VALUES.items()])


def dq_relationships(models: Mapping[str, DataFrame]) -> DataFrame:
    """Q4: child rows whose non-NULL key has no parent row."""
    return _union([_row("relationships", m, c, orphan_count(models[m], c, models[pm], pc))
                   for (m, c), (pm, pc) in RELATIONSHIPS.items()])


def dq_report(models: Mapping[str, DataFrame], figures: Figures = None) -> DataFrame:
    """Q5: all 37 tests in one summary frame, with a pass/fail status.

    One pass per model for Q1 and Q2; with ``figures`` (see ``dq_not_null``) Q1 reads nothing.
    """
    parts = []
    for m, cols in NOT_NULL.items():
        known = _known_nulls(m, figures)
        if known is not None:
            parts.append(_stated(models, m, known))
        if known is None or m in UNIQUE:
            parts.append(column_tests(models[m], cols if known is None else (), UNIQUE.get(m)).select(
                "test", F.lit(m).alias("model"), "column_name", "failures"))
    allr = _union([*parts, dq_accepted_values(models), dq_relationships(models)])
    return allr.withColumn("status", F.when(F.col("failures") == 0, F.lit("pass")).otherwise(F.lit("fail")))


def failing_rows(models: Mapping[str, DataFrame], test: str, model: str, column: str) -> DataFrame:
    """The failing rows of one declared test (Q1-Q4), as ``operators.quality`` defines them."""
    if test == "not_null" and column in NOT_NULL[model]:
        return not_null_failures(models[model], column)
    if test == "unique" and UNIQUE[model] == column:
        return unique_failures(models[model], column)
    if test == "accepted_values":
        return accepted_values_failures(models[model], column, ACCEPTED_VALUES[model, column])
    if test == "relationships":
        parent, field = RELATIONSHIPS[model, column]
        return relationships_failures(models[model], column, models[parent], field)
    raise KeyError((test, model, column))
