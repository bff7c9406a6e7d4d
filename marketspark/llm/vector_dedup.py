"""Operator 12: near-duplicate vectors by collision counting on sorted projections.

Vectors are compared within a (label, length) group only, at unit length.

1. Equal vectors of a group form a class, which takes part once.
2. ``PROJECTIONS`` one-dimensional projections on Gaussian directions are taken
   of each class, once, and carried along, so every task sees equal values.
   On each, two vectors at distance d lie within a window of ``WINDOW`` times
   the link distance with a probability that depends on d alone.
3. A table sorts the classes by one projection, within the cells of a random
   grid over further projections of its own, which keep a list short on a large
   table.  Each vector is the query of the window above it in its list.
4. For each pair in a window the collisions on all projections are counted; a
   pair with fewer than ``least`` is skipped.  ``least`` is calibrated: a pair
   of exactly the link cosine has fewer with a probability of at most ``MISS``.
   The number of tables is calibrated likewise: such a pair meets in one of
   them with a probability of at least ``1 - UNMET``.  Closer pairs are found
   more surely; the number of grid dimensions follows from the largest group.
5. Pairs that pass are verified by their cosine in double precision.  A pair
   counts in the first table only in which it meets, so no pair is shuffled:
   a task hands on, by vector, the number of links found and one link to the
   least vector it reaches among them.

A list of more than ``BLOCK`` classes is cut into blocks by a hash, and each
pair of blocks is a task's work, so no list is gathered whole.

Defined cases: vectors that are NULL, zero, empty or hold NULL or non-finite
components, and those without a label, link with nothing; rows that repeat a
vec_id are vectors of their own; a row with a NULL vec_id links like any other
but is not kept, and has a NULL component_id only where its component has no
vec_id at all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import written
from marketspark.llm.components import components
from marketspark.llm.near_dedup import least_matches

COSINE = 0.93
PROJECTIONS, WINDOW, MISS = 24, 1.5, 0.005
CELL, UNMET = 4.0, 0.03
#: Vectors of a list that a query is meant to meet beside its links, and the distance that these are expected at.
PARTNERS, FAR = 32, math.sqrt(2)
MAX_TABLES = 48
BLOCK, PAIRS = 4096, 1 << 17
SEED = 20250


def _within(window: float, distance: float) -> float:
    """Probability that a Gaussian projection of two vectors at ``distance`` differs by ``window`` at most."""
    return math.erf(window / distance / math.sqrt(2))


def _same_cell(width: float, distance: float) -> float:
    """Probability that both lie in one cell of a randomly shifted grid."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


class Plan:
    """Window, least count, grid dimensions and tables for groups of at most ``largest`` classes."""

    def __init__(self, largest: int, cosine: float = COSINE) -> None:
        self.cosine = cosine
        near = math.sqrt(2 - 2 * cosine)
        self.window, self.cell = WINDOW * near, CELL * near
        hit = _within(self.window, near)
        self.least = least_matches(PROJECTIONS, hit, MISS)
        self.grid = 0
        met = max(largest, 1) * _within(self.window, FAR)
        while met > PARTNERS and self._tables(self.grid + 1) <= MAX_TABLES:
            self.grid += 1
            met *= _same_cell(self.cell, FAR)
        self.tables = self._tables(self.grid)

    def _tables(self, grid: int) -> int:
        near = math.sqrt(2 - 2 * self.cosine)
        meet = _same_cell(self.cell, near) ** grid * _within(self.window, near)
        return math.ceil(math.log(UNMET) / math.log(1 - meet))

    def signature(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(PROJECTIONS float32 values, a hashed grid cell per table) of unit vectors of one length."""
        random = np.random.RandomState(SEED)
        values = (unit @ random.standard_normal((unit.shape[1], PROJECTIONS))).astype(np.float32)
        cells = np.empty((len(unit), self.tables), dtype=np.int32)
        for t in range(self.tables):
            on = unit @ random.standard_normal((unit.shape[1], self.grid)) + random.uniform(0, self.cell, self.grid)
            hashed = np.full(len(unit), t, dtype=np.uint64)
            for c in np.floor(on / self.cell).astype(np.int64).astype(np.uint64).T:
                hashed = (hashed ^ c) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
            cells[:, t] = (hashed & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        return values, cells


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _signed(classes: DataFrame, plan: Plan) -> DataFrame:
    @F.pandas_udf("values array<float>, cells array<int>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch])
            values, cells = [None] * len(batch), [None] * len(batch)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                v, c = plan.signature(unit_vectors(np.stack([batch.iloc[i] for i in at]).astype(float)))
                for row, i in enumerate(at):
                    values[i], cells[i] = v[row], c[row]
            yield pd.DataFrame({"values": values, "cells": cells})

    return classes.withColumn("s", sign("vector")).select("node", "n", "label", "vector", "s.values", "s.cells")


def _lists(signed: DataFrame) -> DataFrame:
    """A row per class and table, and per pair of blocks it belongs to where its list is long."""
    posts = signed.select("*", F.posexplode("cells").alias("table", "cell")).select(
        "node", "n", "vector", "values", "cells", "table", F.get("values", F.col("table") % PROJECTIONS).alias("value"),
        F.xxhash64("label", F.size("vector"), "table", "cell").alias("list"))
    long = written(posts.groupBy("list").agg(F.count(F.lit(1)).alias("posts")).where(F.col("posts") > BLOCK)
                   .select("list", F.ceil(F.col("posts") / BLOCK).cast("int").alias("blocks")), "vector-long")
    cut = posts.join(long, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node", "table"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return cut.select(F.xxhash64("list", low, high).alias("part"), (low != high).alias("across"), "block",
                      "table", "value", "node", "n", "vector", "values", "cells")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least item that each of n items is connected with by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _windows(rows: pd.DataFrame, plan: Plan) -> Iterator[pd.DataFrame]:
    """Links of whole parts, sorted by part and value; all vectors of one length."""
    part, value = rows["part"].to_numpy(), rows["value"].to_numpy().astype(float)
    values, cells = np.stack(rows["values"]).astype(np.float32), np.stack(rows["cells"])
    table, across, block = rows["table"].to_numpy(), rows["across"].to_numpy(), rows["block"].to_numpy()
    node, n = rows["node"].to_numpy(), rows["n"].to_numpy()
    unit = unit_vectors(np.stack(rows["vector"]).astype(float))
    group = np.concatenate([[0], np.cumsum(part[1:] != part[:-1])])
    line = value - value.min() + group * (np.ptp(value) + 2 * plan.window + 1)  # lists one behind the other
    until = np.searchsorted(line, line + plan.window + 1e-6, "right")
    many = until - np.arange(len(line)) - 1
    total, at = np.concatenate([[0], np.cumsum(many)]), 0
    while at < len(line):
        end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        a = np.repeat(np.arange(at, end), many[at:end])
        b = a + 1 + np.arange(len(a)) - (total[a] - total[at])
        at = end
        keep = ~across[a] | (block[a] != block[b])
        a, b = a[keep], b[keep]
        keep = (np.abs(values[a] - values[b]) <= plan.window).sum(axis=1) >= plan.least
        a, b = a[keep], b[keep]
        keep = (unit[a] * unit[b]).sum(axis=1) >= plan.cosine
        a, b = a[keep], b[keep]
        own = np.arange(plan.tables) % PROJECTIONS
        meet = (cells[a] == cells[b]) & (np.abs(values[a] - values[b]) <= plan.window)[:, own]
        keep = meet[np.arange(len(a)), table[a]] & (meet.argmax(axis=1) == table[a])
        a, b = a[keep], b[keep]
        if len(a):
            seen, local = np.unique(np.concatenate([a, b]), return_inverse=True)
            la, lb = local[:len(a)], local[len(a):]
            links = np.bincount(la, weights=n[b], minlength=len(seen)) + np.bincount(lb, weights=n[a], minlength=len(seen))
            yield pd.DataFrame({"node": node[seen], "root": node[seen[_roots(len(seen), la, lb)]], "links": links.astype(np.int64)})


def _links(lists: DataFrame, plan: Plan) -> DataFrame:
    """(node, root, links): by task and vector, links found and a vector reached by them."""
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def whole(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if len(rows):
                lengths = rows["vector"].map(len)
                for length in lengths.unique():
                    yield from _windows(rows[lengths == length].reset_index(drop=True), plan)

        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = rows["part"].to_numpy() == rows["part"].iloc[-1] if len(rows) else np.zeros(0, dtype=bool)
            yield from whole(rows[~last])  # the last part may go on in the next batch
            held = rows[last]
        if held is not None:
            yield from whole(held)

    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(tasks, "part").sortWithinPartitions("part", "value").mapInPandas(found, "node long, root long, links long")


def vector_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(vec_id, h, g) of every row, h NULL where it links with nothing, and the classes of equal vectors by (h, g)."""
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull()
    d = d.withColumn("sound", F.coalesce(sound, F.lit(False)))
    d = d.withColumn("h", F.when(F.col("sound"), F.xxhash64("label", "vector"))) \
        .withColumn("g", F.when(F.col("sound"), F.xxhash64(F.lit("second"), "vector", "label")))
    classes = d.where("sound").groupBy("h", "g").agg(
        F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.any_value("label").alias("label"),
        F.any_value("vector").alias("vector")).withColumn("node", F.monotonically_increasing_id())
    return d.select("vec_id", "h", "g"), written(classes, "vector-classes")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows, classes = vector_classes(vectors)
    largest = classes.groupBy("label", F.size("vector")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    plan = Plan(largest, cosine)
    signed = written(_signed(classes, plan), "vector-signed")
    found = written(_links(_lists(signed), plan), "vector-links")
    member = written(components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "vector-members")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    least = classes.select("node", "least_id").join(member, "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = member.join(least, "component").select("node", "component_id")
    named = written(classes.join(linked, "node", "left").join(of, "node", "left").select(
        "h", "g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "least_id").alias("component_id")), "vector-named")
    return rows.join(named, ["h", "g"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.when(F.col("h").isNull(), F.col("vec_id"))).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
