"""DuckDB oracle SQL for the correctness gate.

Every query is one self-contained statement over the driver tables (region,
nation, customer, supplier, part, orders, lineitem, events, ... registered as
views): the raw-table derivation, the staging / intermediate / mart models
and the report are leading CTEs.  Each model is the direct form of its rule
(separate sets joined, counts spread by joins, distinct counts over joined
rows), not the single-pass or pre-aggregated form of the Spark plan it checks.
Selections and test lists are stated in ``selections``; nothing is imported
from the library.

Conventions: money is summed exactly and rounded once, after the sum; ratios
are DOUBLE, counts BIGINT, months DATE.
"""

from __future__ import annotations

from duckdb_oracle.models import CTES, compose
from duckdb_oracle.reports import REPORT_SQL

__all__ = ["CTES", "compose", "REPORT_SQL", "oracle_queries"]


def oracle_queries() -> dict[str, str]:
    """Query key -> full DuckDB statement."""
    out = {}
    for name in CTES:
        if name.startswith(("stg_", "int_", "dim_", "fct_")):
            out[name] = compose(f"SELECT * FROM {name}", [name])
    for name, (deps, body) in REPORT_SQL.items():
        out[name] = compose(body, deps)
    return out
