"""Exact distinct counts that can be merged: bitmaps over buckets of whole-number ids.

A state row holds, for some group columns, one bucket of ids as a bitmap
(Spark's own bitmap functions: 32,768 ids a bucket, 4 KB) and the number of
rows counted.  States merge by OR, so a report over fewer group columns reads
states only, never rows.  Bitmaps suit ids that are numbered densely; sparse
ids cost a bitmap each before compression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET, IDS, ROWS = "bucket", "ids", "row_count"


def distinct_state(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """(keys, bucket, ids, row_count): the ids of each group; rows with a NULL id are counted in a row without a bucket.

    Rows are reduced to one per group and id first, map-side and in one shuffle;
    the second shuffle brings a bucket's ids together, at most 32,768 of a group.
    """
    pairs = df.groupBy(*keys, F.col(id_col).cast("bigint").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    placed = pairs.withColumn(BUCKET, F.bitmap_bucket_number("__id")).repartition(*keys, BUCKET)
    ids = F.bitmap_construct_agg(F.bitmap_bit_position("__id"))
    return placed.groupBy(*keys, BUCKET).agg(F.when(F.col(BUCKET).isNotNull(), ids).alias(IDS), F.sum("__n").alias(ROWS))


def merged_distinct(state: DataFrame, keys: Sequence[str], distinct: str, rows: str | None = None) -> DataFrame:
    """Distinct ids (and rows) per ``keys``, a subset of the state's group columns; without keys one row."""
    merged = state.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(IDS).alias(IDS), F.sum(ROWS).alias(ROWS))
    held = F.when(F.col(BUCKET).isNotNull(), F.bitmap_count(IDS))
    figures = [F.coalesce(F.sum(held), F.lit(0).cast("bigint")).alias(distinct)]
    if rows is not None:
        figures.insert(0, F.coalesce(F.sum(ROWS), F.lit(0).cast("bigint")).alias(rows))
    return merged.groupBy(*keys).agg(*figures)
