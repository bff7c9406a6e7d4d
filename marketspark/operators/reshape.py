"""Pivot, unpivot and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_sum(
    df: DataFrame,
    index: str,
    column: str,
    value: str,
    values: Sequence | None = None,
    fill=0,
    label=None,
) -> DataFrame:
    """``pivot_table(index, columns, values, aggfunc='sum').fillna(fill)``.

    With explicit ``values`` the output schema is fixed and no extra job runs
    to discover the distinct column values.  Without them Spark collects the
    distinct values of ``column`` first (bounded by the column's domain, e.g.
    event types), which matches a data-driven pivot.  NULL keys are dropped as
    in pandas.  ``label`` renames each pivot value's column (``v -> name``).
    """
    src = df.where(F.col(index).isNotNull() & F.col(column).isNotNull())
    g = src.groupBy(index)
    pivoted = (g.pivot(column, list(values)) if values is not None else g.pivot(column)).agg(F.sum(value))
    if label is not None:
        pivoted = pivoted.select(index, *[F.col(f"`{c}`").alias(label(c)) for c in pivoted.columns if c != index])
    value_cols = [c for c in pivoted.columns if c != index]
    return pivoted.na.fill(fill, subset=value_cols) if value_cols else pivoted


def unpivot_long(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str],
                 variable: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long: one row per (ids, value column)."""
    return df.unpivot(list(ids), list(value_cols), variable, value)


def top_k(df: DataFrame, k: int, order_by: Sequence[Column]) -> DataFrame:
    """First ``k`` rows under ``order_by``.

    ``orderBy().limit(k)`` plans as ``TakeOrderedAndProject``: every partition
    keeps its own top k and only those k-per-partition rows are merged, so no
    full sort or shuffle of the input happens.
    """
    return df.orderBy(*order_by).limit(k)
