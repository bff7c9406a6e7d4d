"""marketspark: an e-commerce marketing warehouse built on Spark DataFrames.

Five raw tables (customers, campaigns, products, events, transactions) are
cleaned and deduplicated (``plans.staging``), turned into order histories,
cohorts and funnels (``plans.intermediate``), materialised as dimension and
fact tables (``plans.marts``), and queried by report functions
(``plans.reports``) and data-quality jobs (``plans.quality``).
``plans.warehouse.build_all`` runs the whole rebuild in dependency order.
"""

from marketspark.session import get_or_create_session

__all__ = ["get_or_create_session"]
