"""Operator 8: sharding by best-fit-decreasing bin packing (law ``bytes``).

Rows of equal text form an indivisible group whose size is the sum of its rows'
sizes (UTF-8 bytes of the text + 16).  Groups in decreasing size enter the bin
with the tightest sufficient remaining capacity, found in a balanced tree keyed
by remaining capacity; the smallest capacity at which the wanted number of bins
suffices is searched.  A group above the mean shard size gets a shard of its
own, and the rest is packed into the others.

All groups are packed by their own size, at any size of the table.  Equal sizes
share one entry of the agenda: what the driver holds is the list of distinct
sizes with their counts, at most as many as the largest group has bytes, and a
size's entry names the bins that its groups enter and how many each.  Groups are
ranked within their size, and rows within their shard, by a range partitioning:
they are numbered inside each part, and the counts of earlier parts are added.

Defined cases: NULL text has size 16 and forms a group of its own (as does the
empty text, which is another text); rows that repeat are equal texts and share
a shard; a NULL doc_id sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import id_and_text, written

SHARDS, OVERHEAD = 40, 16
#: Capacities are searched from the mean upward to this relative precision.
PRECISION = 1e-4


class CapacityTree:
    """AVL tree over (remaining capacity, bin) with insert, remove and least-not-below."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # node: [key, left, right, height]

    @staticmethod
    def _height(n):
        return n[3] if n else 0

    def _fix(self, n):
        height = self._height
        if height(n[1]) - height(n[2]) > 1:
            if height(n[1][1]) < height(n[1][2]):
                n[1] = self._rotate(n[1], 2, 1)
            return self._rotate(n, 1, 2)
        if height(n[2]) - height(n[1]) > 1:
            if height(n[2][2]) < height(n[2][1]):
                n[2] = self._rotate(n[2], 1, 2)
            return self._rotate(n, 2, 1)
        n[3] = 1 + max(height(n[1]), height(n[2]))
        return n

    def _rotate(self, n, up, other):
        """Lift the child on side ``up``."""
        top = n[up]
        n[up], top[other] = top[other], n
        n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        top[3] = 1 + max(self._height(top[1]), self._height(top[2]))
        return top

    def insert(self, key):
        def put(n):
            if n is None:
                return [key, None, None, 1]
            side = 1 if key < n[0] else 2
            n[side] = put(n[side])
            return self._fix(n)

        self.root = put(self.root)

    def remove(self, key):
        def cut(n, key):
            if key < n[0]:
                n[1] = cut(n[1], key)
            elif key > n[0]:
                n[2] = cut(n[2], key)
            elif n[1] is None or n[2] is None:
                return n[1] or n[2]
            else:
                least = n[2]
                while least[1]:
                    least = least[1]
                n[0] = least[0]
                n[2] = cut(n[2], least[0])
            return self._fix(n)

        self.root = cut(self.root, key)

    def tightest(self, size):
        """Smallest key whose capacity is at least ``size``, or None."""
        n, found = self.root, None
        while n:
            if n[0][0] >= size:
                found, n = n[0], n[1]
            else:
                n = n[2]
        return found


Runs = list[tuple[int, int]]


def best_fit_runs(sizes: list[int], counts: list[int], capacity: int, bins: int) -> list[Runs] | None:
    """(items, bin) runs of each size, or None if ``bins`` don't suffice; ``counts`` items of each of the falling ``sizes``.

    The tightest bin for an item stays the tightest one for the next of equal
    size as long as it can hold it, so equal items enter it together.
    """
    tree, opened, out = CapacityTree(), 0, []
    for size, count in zip(sizes, counts, strict=True):
        runs: Runs = []
        while count:
            key = tree.tightest(size)
            if key is None:
                if opened == bins or size > capacity:
                    return None
                key, opened = (capacity, opened), opened + 1
            else:
                tree.remove(key)
            n = min(count, key[0] // size)
            runs.append((n, key[1]))
            tree.insert((key[0] - n * size, key[1]))
            count -= n
        out.append(runs)
    return out


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int) -> list[int] | None:
    """Bin of each item (``sizes`` in decreasing order), or None if ``bins`` don't suffice."""
    runs = best_fit_runs(sizes, [1] * len(sizes), capacity, bins)
    return None if runs is None else [r[0][1] for r in runs]


def pack(sizes: list[int], counts: list[int], bins: int) -> list[Runs]:
    """The runs of each of the falling ``sizes``, the bins' sums near equal."""
    sizes, left = list(sizes), list(counts)
    out: list[Runs] = [[] for _ in sizes]
    rest = sum(s * n for s, n in zip(sizes, left, strict=True))
    first = at = 0
    while at < len(sizes) and bins - first > 1 and sizes[at] * (bins - first) > rest:
        out[at].append((1, first))  # above the mean of what is left: a bin of its own
        first, rest, left[at] = first + 1, rest - sizes[at], left[at] - 1
        at += left[at] == 0
    if at == len(sizes):
        return out
    sizes, left, n = sizes[at:], left[at:], bins - first
    least = max(sizes[0], -(-rest // n))
    step, slack, low = PRECISION, 0.0, 0.0
    while (found := best_fit_runs(sizes, left, int(least * (1 + slack)), n)) is None:
        low, slack, step = slack, slack + step, step * 2
    while slack - low > PRECISION:
        middle = (low + slack) / 2
        better = best_fit_runs(sizes, left, int(least * (1 + middle)), n)
        low, slack, found = (low, middle, better) if better is not None else (middle, slack, found)
    for i, runs in enumerate(found, at):
        out[i] += [(items, first + b) for items, b in runs]
    return out


def group_shards(rows: DataFrame, shards: int) -> DataFrame:
    """(digest, shard) of each group of equal texts.

    Groups of one size are interchangeable, so the driver packs the list of
    distinct sizes with their counts, and groups enter the bins of their size in
    the order of their digests.
    """
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("size")), "shard-groups")
    histogram = groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("size", ascending=False)
    packed = pack(histogram["size"].tolist(), histogram["n"].tolist(), shards)
    runs = [(size, [{"until": int(until), "shard": b} for until, (_, b) in zip(accumulate(n for n, _ in of), of, strict=True)])
            for size, of in zip(histogram["size"].tolist(), packed, strict=True)]
    bins = written(rows.sparkSession.createDataFrame(pd.DataFrame(runs, columns=["size", "runs"]),
                                                     "size long, runs array<struct<until: long, shard: int>>"), "shard-sizes")
    ranked = number_rows(groups, "size", ["digest"])
    return written(ranked.join(bins, "size").select("digest", F.filter("runs", lambda r: r["until"] > F.col("slot"))[0]["shard"]
                                                    .alias("shard")), "shard-groups")


def number_rows(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Gapless ``slot`` from 0 within each ``group``, without gathering a group in one task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, inner long"

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        seen: dict = {}
        for batch in batches:
            inner = batch.groupby(group, sort=False).cumcount().astype("int64")
            inner += batch[group].map(lambda g: seen.get(g, 0)).astype("int64")
            for g, n in batch[group].value_counts().items():
                seen[g] = seen.get(g, 0) + int(n)
            yield batch.assign(part=part, inner=inner)

    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(ordered.mapInPandas(number, schema), "shard-rows")
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per part and group in it: range parts and groups overlap in parts + groups rows at most.
    starts = written(placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n")).select(
        group, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "shard-starts")
    return placed.join(starts, [group, "part"]).withColumn("slot", F.col("before") + F.col("inner")) \
        .drop("part", "inner", "before")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.col("text")
    rows = written(id_and_text(docs).select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("digest")), "shard-input")
    # Both sides are plain reads: a text that very many rows share is split by the skew join.
    placed = rows.join(group_shards(rows, shards), "digest").select("doc_id", "size", "text_crc32", "shard")
    return number_rows(placed, "shard", ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
