"""Keep-first deduplication per key.

``row_number() over (partition by key order by ...) = 1`` is planned by
Catalyst as a ``WindowGroupLimit`` pair: a *Partial* limit runs before the
shuffle (each map task forwards at most one row per key), then a *Final*
limit after it.  A hot key holding a third of the rows therefore ships only
one row per map partition, instead of all its copies, to one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROW_NUM = "__row_num"


def dedupe_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column],
                 total_order: bool = True) -> DataFrame:
    """Keep the first row per ``keys`` under ``order_by``.

    Callers pass explicit null ordering (the warehouse SQL sorts NULL last in
    ascending order, Spark's default is NULL first) and any tie-break columns
    the result must follow.  With ``total_order`` every remaining column is
    appended as a last tie-break, so rows tied on ``order_by`` are resolved the
    same way on every run: a task retried after an executor loss (whose
    shuffle input can arrive in a different order) keeps the same row.  Those
    keys are only compared on ties, so the cost is negligible.
    """
    order = list(order_by)
    if total_order:
        order += [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_ROW_NUM, F.row_number().over(w)).where(F.col(_ROW_NUM) == 1).drop(_ROW_NUM)
