"""Wiring of the 20 relations, and the full rebuild (``build_all``).

``build_models`` returns every relation as a lazy DataFrame (the dependency
graph is just function composition, resolved on first access).  ``build_all`` materialises it:

* the staging tables are written once, because downstream models and data tests
  read them; each consumer then scans the written, already deduplicated Parquet
  (with column pruning) instead of repeating the dedupe shuffle.  Intermediate
  models stay lazy views.
* the ten marts are written in dependency order; marts built on other marts
  (customer metrics, product conversion, cohort retention) read the written
  upstream table, which also cuts their lineage.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.plans import intermediate as I
from marketspark.plans import marts as M
from marketspark.plans import quality as Q
from marketspark.plans import staging as S
from marketspark.session import scratch_root
from marketspark.sources.sinks import materialise, read_range, table_records

STAGING = ("stg_customers", "stg_campaigns", "stg_products", "stg_events", "stg_transactions")
INTERMEDIATE = ("int_funnel_steps", "int_cart_activity", "int_customer_cohorts", "int_customer_orders",
                "int_product_funnel")
#: Facts whose files are laid out by time, with the id to split a moment that many rows share (``facts_between``).
RANGES = {"fct_transactions": ("transaction_timestamp", "transaction_id")}
Builder = Callable[[Mapping[str, DataFrame]], DataFrame]

MARTS = ("dim_customers", "dim_products", "dim_campaigns", "fct_transactions", "fct_customer_metrics",
         "fct_product_conversion", "fct_cohort_retention", "fct_traffic_conversion", "fct_traffic_monthly",
         "fct_experiment_groups")
#: Written like marts, beside the 20 relations: states that reports merge.
STATES = ("agg_event_customers",)


class Relations(Mapping[str, DataFrame]):
    """The relation graph, built on first access and memoised.

    ``builders`` maps a name to ``fn(relations) -> DataFrame``; a builder reads
    its inputs through the mapping, so asking for one mart analyses only its
    upstream models.  ``on_mart(name, df) -> df`` wraps each mart as it is
    built (``build_all`` writes it and continues from the written table).
    """

    def __init__(self, builders: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]],
                 on_mart: Callable[[str, DataFrame], DataFrame] | None = None):
        self._builders = dict(builders)
        self._on_mart = on_mart
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            df = self._builders[name](self)
            if self._on_mart is not None and name in (*MARTS, *STATES):
                df = self._on_mart(name, df)
            self._built[name] = df
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def staging_builders(raw: Mapping[str, DataFrame],
                     tie_breaks: Mapping[str, Sequence[str]] | None = None) -> dict[str, Builder]:
    tb = dict(tie_breaks or {})
    return {
        "stg_customers": lambda m: S.stg_customers(raw["customers"]),
        "stg_campaigns": lambda m: S.stg_campaigns(raw["campaigns"]),
        "stg_products": lambda m: S.stg_products(raw["products"], tb.get("products", ())),
        "stg_events": lambda m: S.stg_events(raw["events"], tb.get("events", ())),
        "stg_transactions": lambda m: S.stg_transactions(raw["transactions"], tb.get("transactions", ())),
    }


# Intermediate models and marts, each as a function of the relation mapping.
DOWNSTREAM: dict[str, Builder] = {
    "int_funnel_steps": lambda m: I.int_funnel_steps(m["stg_events"]),
    "int_cart_activity": lambda m: I.int_cart_activity(m["stg_events"]),
    "int_customer_cohorts": lambda m: I.int_customer_cohorts(m["stg_customers"]),
    "int_customer_orders": lambda m: I.int_customer_orders(m["stg_transactions"]),
    "int_product_funnel": lambda m: I.int_product_funnel(m["int_funnel_steps"]),
    "dim_customers": lambda m: M.dim_customers(m["stg_customers"], m["int_customer_orders"]),
    "dim_products": lambda m: M.dim_products(m["stg_products"], m["int_product_funnel"]),
    "dim_campaigns": lambda m: M.dim_campaigns(m["stg_campaigns"]),
    "fct_transactions": lambda m: M.fct_transactions(m["stg_transactions"]),
    "fct_customer_metrics": lambda m: M.fct_customer_metrics(m["dim_customers"]),
    "fct_product_conversion": lambda m: M.fct_product_conversion(m["dim_products"], m["stg_transactions"]),
    "fct_cohort_retention": lambda m: M.fct_cohort_retention(m["int_customer_cohorts"], m["fct_transactions"]),
    "agg_event_customers": lambda m: M.agg_event_customers(m["stg_events"]),
    "fct_traffic_conversion": lambda m: M.fct_traffic_conversion(m["stg_events"]),
    "fct_traffic_monthly": lambda m: M.fct_traffic_monthly(m["stg_events"]),
    "fct_experiment_groups": lambda m: M.fct_experiment_groups(m["stg_events"]),
}


def staging_models(raw: Mapping[str, DataFrame],
                   tie_breaks: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """The five staging relations (lazy)."""
    stg = Relations(staging_builders(raw, tie_breaks))
    return {n: stg[n] for n in STAGING}


def downstream_models(stg: Mapping[str, DataFrame],
                      on_mart: Callable[[str, DataFrame], DataFrame] | None = None) -> Relations:
    """Intermediate models and marts over the given staging frames."""
    fixed = {n: (lambda m, df=df: df) for n, df in stg.items()}
    return Relations({**fixed, **DOWNSTREAM}, on_mart)


def build_models(raw: Mapping[str, DataFrame],
                 tie_breaks: Mapping[str, Sequence[str]] | None = None) -> Relations:
    """All 20 relations, built lazily on access (nothing runs until an action)."""
    return Relations({**staging_builders(raw, tie_breaks), **DOWNSTREAM})


def observed_figures(name: str) -> dict[str, Column]:
    """What is observed while a model is written: figures of its data tests, and the columns of a later pivot."""
    figures = Q.observed_figures(name)
    if name == "fct_traffic_conversion":
        figures["values:event_type"] = F.collect_set("event_type")  # one per event type, few
    return figures


def _folders(root: str) -> dict[str, str]:
    return {**{n: os.path.join(root, "staging", n) for n in STAGING},
            **{n: os.path.join(root, "marts", n) for n in (*MARTS, *STATES)}}


def build_all(spark: SparkSession, raw: Mapping[str, DataFrame], root: str | None = None,
              tie_breaks: Mapping[str, Sequence[str]] | None = None,
              shared_staging: Sequence[str] = STAGING, version: str | None = None) -> dict[str, DataFrame]:
    """Full rebuild: write the staging tables and all marts under ``root``.

    ``root`` must be a folder every executor can reach (on a cluster, the
    shared warehouse location, never a machine-local path); by default it is
    a ``warehouse`` folder under the session's ``spark.checkpoint.dir``.
    Returns all 20 relations and the states; marts and shared staging are scans
    of the written Parquet tables.

    Each table is replaced when its own write is complete (``sources.sinks``),
    so a failed rebuild leaves readable tables.  With a ``version`` of the input
    (``sources.input_version``), a table that stands complete for it is kept, so
    the rebuild after a failure goes on where it stopped; code that changes a
    model belongs into the version too.  What the data tests count is observed
    on the way (``written_figures``).
    """
    if root is None:
        root = scratch_root(spark, "warehouse")

    def write(layer: str, name: str, df: DataFrame) -> DataFrame:
        return materialise(spark, df, os.path.join(root, layer), name, version=version, observe=observed_figures(name),
                           range_by=RANGES.get(name, ()))

    stg = staging_models(raw, tie_breaks)
    for name in shared_staging:
        stg[name] = write("staging", name, stg[name])
    models = downstream_models(stg, on_mart=lambda name, df: write("marts", name, df))
    for name in (*MARTS, *STATES):  # dependency order
        models[name]
    return {n: models[n] for n in models}


def written_figures(spark: SparkSession, root: str | None = None) -> dict[str, Mapping]:
    """By model, the figures observed when its present table was written."""
    folders = _folders(scratch_root(spark, "warehouse") if root is None else root)
    return {n: r.figures for n, r in table_records(spark, list(folders.values())).items()}


def facts_between(spark: SparkSession, low, high, root: str | None = None, name: str = "fct_transactions") -> DataFrame:
    """Rows of a written fact table with ``low <= time < high``, from the files that hold such rows only."""
    folder = _folders(scratch_root(spark, "warehouse") if root is None else root)[name]
    return read_range(spark, folder, RANGES[name][0], low, high)


def event_types(figures: Mapping[str, Mapping]) -> list[str]:
    """The event types of the written traffic mart, for ``reports.event_mix`` without a job of its own."""
    return sorted(figures["fct_traffic_conversion"]["values:event_type"])


def cache_marts(models: Mapping[str, DataFrame], names: Sequence[str] = MARTS,
                storage: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> dict[str, DataFrame]:
    """Keep loaded marts in executor memory for repeated report queries.

    The report pages reuse one loaded mart for many charts; persisting the
    written mart scans does the same on the cluster.  A lost cached block is
    rebuilt from its Parquet files, so executor loss costs a re-read only.
    Call ``release_marts`` when the reports are done.
    """
    out = dict(models)
    for name in names:
        out[name] = models[name].persist(storage)
    return out


def release_marts(models: Mapping[str, DataFrame], names: Sequence[str] = MARTS) -> None:
    for name in names:
        models[name].unpersist()
