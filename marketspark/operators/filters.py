"""Report filters: AND of per-column membership selections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def isin_filters(df: DataFrame, **selections: Iterable | None) -> DataFrame:
    """Keep rows whose column value is in the selection, for each given column.

    An empty or ``None`` selection means "no filter" (an empty multi-select
    shows everything).  Several columns AND together.  A plain ``IN`` predicate
    on a scanned column is pushed down to the Parquet reader.
    """
    cond = None
    for col_name, values in selections.items():
        vals = list(values or [])
        if not vals:
            continue
        c = F.col(col_name).isin(vals)
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)
