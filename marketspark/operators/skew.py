"""Heavy keys: found by a bounded summary, and spread over several tasks.

``heavy_keys`` reads the key columns once.  Each task keeps a frequent-items
sketch of ``TRACKED`` entries (``approx_top_k``), and the sketches are merged, so
neither a task nor the result grows with the number of keys.  A key that holds
more than one in ``1 / HEAVY_SHARE`` rows can't be missed: the sketch's error
is below a quarter of that.

A heavy key gets parts in proportion to its rows, each of about ``HEAVY_SHARE``
of the table; all other keys have the one part 0.  There are at most
``2 / HEAVY_SHARE`` parts beyond that in total, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Share of a table's rows from which a key is heavy, and the entries that find it (a power of two).
HEAVY_SHARE = 1 / 1024
TRACKED = 1 << 14

_HASH, _PARTS, PART = "__key_hash", "__parts", "__part"


def key_hash(df: DataFrame, keys: Sequence[str], types: StructType | None = None) -> Column:
    """Hash of the key columns as values of ``types`` (their own by default): equal keys of different types differ in hash."""
    return F.xxhash64(*[F.col(k).cast((types or df.schema)[k].dataType) for k in keys])


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE, types: StructType | None = None) -> DataFrame:
    """(key hash, parts) of the keys that hold over ``share`` of the rows of ``df``; at most ``1 / share`` rows."""
    most = round(1 / share)
    top = df.select(key_hash(df, keys, types).alias("h")).agg(
        F.expr(f"approx_top_k(h, {most}, {max(TRACKED, 16 * most)})").alias("top"), F.count(F.lit(1)).alias("n"))
    found = top.select(F.explode("top").alias("t"), (F.col("n") * share).alias("least")).where(F.col("t.count") > F.col("least"))
    return found.select(F.col("t.item").alias(_HASH), F.ceil(F.col("t.count") / F.col("least")).cast("int").alias(_PARTS))


def spread_sides(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: str,
                 share: float = HEAVY_SHARE) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` with a column ``PART`` that belongs to the join keys.

    Rows of ``left`` that hold a heavy key are dealt over its parts by a hash of
    ``spread_by`` (a column that differs between them); rows of ``right`` with
    that key stand once per part, all others once.  ``right`` should hold few
    rows per key.  The heavy keys are broadcast: at most ``1 / share`` small rows.
    """
    types = left.select(*keys).union(right.select(*keys)).schema  # those in which the join compares
    heavy = F.broadcast(heavy_keys(left, keys, share, types))
    dealt = left.withColumn(_HASH, key_hash(left, keys, types)).join(heavy, _HASH, "left").withColumn(
        PART, F.when(F.col(_PARTS).isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.col(_PARTS))).cast("int"))
    copied = right.withColumn(_HASH, key_hash(right, keys, types)).join(heavy, _HASH, "left").withColumn(
        PART, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_PARTS), F.lit(1)) - 1)))
    return dealt.drop(_HASH, _PARTS), copied.drop(_HASH, _PARTS)
