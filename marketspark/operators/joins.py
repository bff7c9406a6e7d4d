"""Join patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators.skew import PART, spread_sides

_MATCHES = "__matches"


def match_counts(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per non-NULL key with its number of rows; combines map-side."""
    known = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return right.select(*keys).where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias(_MATCHES))


def left_join_match_flag(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    flag: str,
    spread_by: str,
) -> DataFrame:
    """``left LEFT JOIN right USING (keys)`` keeping only a 0/1 ``flag`` from the right.

    The result equals the plain left join, fan-out included: a left row with
    ``n`` matching right rows appears ``n`` times with ``flag = 1``, a row with
    none appears once with ``flag = 0``.  NULL keys never match.

    Instead of joining raw right rows (which sends every copy of a hot key to
    one task and builds all pairs there), the right side is first reduced to
    one row per key with its match count.  Left rows of a key that holds a
    large share of them are dealt over several parts by a hash of ``spread_by``
    (a column that differs between rows of a key), and only such a key's count
    is copied to its parts (``operators.skew``).
    """
    dealt, counts = spread_sides(left, match_counts(right, keys), keys, spread_by)
    joined = dealt.join(counts, [*keys, PART], "left") \
        .withColumn(flag, F.when(F.col(_MATCHES).isNotNull(), F.lit(1)).otherwise(F.lit(0))) \
        .withColumn(_MATCHES, F.coalesce(F.col(_MATCHES), F.lit(1)))
    return _repeat_rows(joined, _MATCHES).drop(_MATCHES, PART)


_CHUNK = 4096


def _repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Emit each row ``times`` times, with bounded memory per row.

    Copies are generated in two levels: ``ceil(n / _CHUNK)`` chunk rows, each
    expanded to at most ``_CHUNK`` copies, and ``explode`` streams them.  The
    largest array built for a row is ``n / _CHUNK`` entries instead of ``n``,
    so a key matched by millions of rows never builds a millions-long array.
    """
    n = F.col(times).cast("long")
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / _CHUNK).cast("long"))
    with_chunk = df.withColumn("__chunk", F.explode(chunks))
    in_chunk = F.least(F.lit(_CHUNK).cast("long"), n - F.col("__chunk") * _CHUNK).cast("int")
    return with_chunk.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), in_chunk))) \
        .drop("__chunk", "__copy")
