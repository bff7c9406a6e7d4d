"""Data-test operators: each returns its failing rows as a DataFrame.

Semantics follow the usual declarative column tests:

* ``not_null``: rows where the column is NULL.
* ``unique``: one row per non-NULL value occurring more than once.
* ``accepted_values``: one row per distinct non-NULL value outside the list.
* ``relationships``: child rows with a non-NULL key that has no parent row.

``failure_counts`` turns a set of tests into one small summary frame with a
single aggregation per model for the NULL checks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null_failures(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique_failures(df: DataFrame, column: str) -> DataFrame:
    # Partial aggregation collapses every copy of a hot value map-side.
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("n_records")).where(F.col("n_records") > 1))


def accepted_values_failures(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return (df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(values)))
            .groupBy(column).agg(F.count(F.lit(1)).alias("n_records")))


def relationships_failures(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Child rows whose key is missing from the parent (``LEFT ANTI JOIN``).

    The parent side is reduced to its distinct keys first, so the join is
    many-to-one however often a parent key repeats.
    """
    keys = parent.select(F.col(field).alias("__parent_key")).where(F.col("__parent_key").isNotNull()).distinct()
    c = child.where(F.col(column).isNotNull())
    return c.join(keys, c[column] == keys["__parent_key"], "left_anti")


def orphan_count(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Number of those child rows: the child is reduced to (key, rows) map-side before it is shuffled."""
    keyed = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_records"))
    orphans = relationships_failures(keyed, column, parent, field)
    return orphans.agg(F.coalesce(F.sum("n_records"), F.lit(0).cast("bigint")).alias("failures"))


def column_tests(df: DataFrame, not_null: Sequence[str], unique: str | None) -> DataFrame:
    """(test, column_name, failures) of a model's NULL and uniqueness tests in one pass.

    With a unique column, rows are grouped by it carrying the NULL counts of
    the other columns, so one shuffle of reduced rows serves all the tests.
    """
    if unique is not None:
        others = [c for c in not_null if c != unique]
        df = df.groupBy(unique).agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in others])
    figures = []
    for c in not_null:
        nulls = F.count_if(F.col(c).isNull()) if unique is None else \
            F.sum(F.when(F.col(c).isNull(), F.col("__n"))) if c == unique else F.sum(c)
        figures.append(("not_null", c, nulls))
    if unique is not None:
        figures.append(("unique", unique, F.count_if(F.col(unique).isNotNull() & (F.col("__n") > 1))))
    one = df.agg(*[F.coalesce(x, F.lit(0).cast("bigint")).alias(f"__{i}") for i, (_, _, x) in enumerate(figures)])
    rows = F.array(*[F.struct(F.lit(t).alias("test"), F.lit(c).alias("column_name"), F.col(f"__{i}").alias("failures"))
                     for i, (t, c, _) in enumerate(figures)])
    return one.select(F.inline(rows))

def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One pass over ``df``: NULL count per column, as (column, failures) rows."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return agg.unpivot([], list(columns), "column_name", "failures")
