"""Operator 11: source divergence audit over a quadtree of the group-term count matrix.

For each lang, rows are its (lang, source) groups and columns its kept terms
(in at least ``MIN_DOCS`` documents of the lang).  The matrix is held as
K-squared trees (K = 2): tiles of ``SIDE`` x ``SIDE`` cells, each a bitmap per
level that tells which quadrants of a nonzero quadrant are nonzero, and the
nonzero leaves in Morton order.  Tiles that are all zero are not stored.

A pair of groups costs f(p, q) per column.  Where both have no occurrence the
cost depends on the pair only, so the whole matrix is priced as one zero
quadrant first: columns times that cost.  The trees of two row blocks are then
traversed jointly over the columns; a quadrant pair without a nonzero cell ends
there, and each nonzero leaf of either side adds what its cost differs by.
Parts of a pair's sum come from different column blocks and are added in Spark.

p = 1 + floor(10^9 (count + 2) / (N + 2 V)) and f = floor((p - q)^2 / (p + q))
are taken in 64-bit integers without overflow (totals below 9 * 10^15).

Terms are maximal runs of ASCII letters and non-ASCII characters; A-Z alone are
lower-cased.  Columns are placed by a hash of the term into blocks and by
falling count within one, rows by a hash of the source, so no lang passes
through one task.

Defined cases: NULL text, lang and source read as ''; every row counts as a
document, repeated ones too; a group without terms takes part; a lang without
kept terms gives pairs of value 0 and no terms; ties in value are ranked by
item; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import blocks, written
from marketspark.llm.spelling_variants import Numbered

MIN_DOCS, TOP_TERMS = 10, 10
LEVELS = 10
SIDE = 1 << LEVELS
#: Columns or rows that a block is meant to hold; more of them open a further one.
FILL = 768
#: Quadrant pairs that are expanded at once.
FRONTIER = 1 << 16
#: Distinct terms, and term counts, that a task holds before it hands its counts on.
HELD, HELD_COUNTS = 250_000, 1_000_000
SLICE = 50_000
COUNTED = ["lang", "source", "term", "n", "docs"]
#: A-Z become a-z, all other characters below 0x80 but letters a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Counts:
    """Occurrences and documents by group and term, as seen by one task."""

    def __init__(self) -> None:
        self.groups = Numbered()
        self.clear()

    def clear(self) -> None:
        self.terms = Numbered()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, groups: list[tuple[str, str]], texts: list[str]) -> None:
        found = [t.encode().translate(TERM_BYTES).split() for t in texts]
        lengths = np.array([len(f) for f in found])
        terms = np.fromiter(map(self.terms.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(lengths.sum()))
        group = np.array([self.groups[g] for g in groups], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), lengths)
        each, n = np.unique(doc << 32 | terms, return_counts=True)  # a document and a term
        key = group[each >> 32] << 32 | (each & 0xFFFFFFFF)
        self._keep(key, n, np.ones(len(key), dtype=np.int64))

    def _keep(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        key, n, docs = key[order], n[order], docs[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        self.parts.append((key[first], np.add.reduceat(n, first), np.add.reduceat(docs, first)) if len(key) else (key, n, docs))
        self.held += len(first)

    def batches(self) -> Iterator[pa.RecordBatch]:
        parts, self.parts = self.parts, []
        self._keep(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        (key, n, docs), groups = self.parts[0], list(self.groups)
        terms = pa.array([t.decode() for t in self.terms], type=pa.string())
        langs, sources = (pa.array([g[i] for g in groups], type=pa.string()) for i in (0, 1))
        for at in range(0, len(key), SLICE):
            part = slice(at, at + SLICE)
            group, term = pa.array(key[part] >> 32), pa.array(key[part] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(term), pa.array(n[part]),
                                              pa.array(docs[part])], names=COUNTED)
        # Each group once without a term, so that none is lost.
        none = np.zeros(len(groups), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(groups), pa.string()), pa.array(none), pa.array(none)], names=COUNTED)
        self.clear()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        langs, sources, texts = (batch.column(c).to_pylist() for c in ("lang", "source", "text"))
        groups = list(zip(langs, sources, strict=True))
        for a, b in blocks(texts):
            counts.add(groups[a:b], texts[a:b])
            if len(counts.terms) > HELD or counts.held > HELD_COUNTS:
                yield from counts.batches()
    if counts.parts:
        yield from counts.batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs); a row with a NULL term for each group."""
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return d.mapInArrow(_count, "lang string, source string, term string, n long, docs long") \
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of two longs."""
    return F.call_function("div", a, b)


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 n / total) for n <= total, three decimal digits at a time."""
    out, rest = F.lit(0).cast("long"), n.cast("long")
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, total), rest * 1000 % total
    return out + 1


def cost(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _placed(df: DataFrame, size: str, item: str, order: list[Column], block: str, place: str) -> DataFrame:
    """Adds a block of at most SIDE items of a lang, and a place in it.

    Blocks are told by a hash of the item, so that a lang with many items is
    numbered in many tasks; what a hash brings beyond SIDE opens a further block.
    """
    part = F.pmod(F.xxhash64(item), F.ceil(F.col(size) / FILL))
    row = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)) - 1
    return df.withColumn("part", part).withColumn("row", row).select(
        *df.columns, (F.col("part") * (1 << 20) + _div(F.col("row"), F.lit(SIDE))).alias(block),
        (F.col("row") % SIDE).cast("int").alias(place))


# ------------------------------------------------------------------ the tree of a tile

def _spread(x: np.ndarray) -> np.ndarray:
    """Bit i to bit 2 i, for values below 2^16."""
    x = (x | x << 8) & 0x00FF00FF
    x = (x | x << 4) & 0x0F0F0F0F
    x = (x | x << 2) & 0x33333333
    return (x | x << 1) & 0x55555555


def build_tree(row: np.ndarray, column: np.ndarray, p: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """(nodes per level, their four-bit maps level by level, leaf values) of the nonzero cells of a tile."""
    code = _spread(row.astype(np.int64)) << 1 | _spread(column.astype(np.int64))
    order = np.argsort(code)
    code, sizes, maps = code[order], [], []
    for level in range(LEVELS):
        nodes = np.unique(code >> 2 * (LEVELS - level))
        below = np.unique(code >> 2 * (LEVELS - level - 1))
        held = np.bincount(np.searchsorted(nodes, below >> 2), weights=1 << (below & 3), minlength=len(nodes))
        sizes.append(len(nodes))
        maps.append(held.astype(np.uint8))
    return sizes, np.concatenate(maps).tobytes(), p[order].astype(np.int64).tobytes()


_ONES = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)


class Side:
    """One row block over one column block: the zero shares of its rows, and its tree if a cell is nonzero."""

    def __init__(self, zero: np.ndarray, sizes, maps: bytes | None, values: bytes | None) -> None:
        self.zero = np.asarray(zero, dtype=np.int64)
        self.full = values is not None
        if self.full:
            ends = np.cumsum(sizes)
            self.maps = [np.frombuffer(maps, dtype=np.uint8)[a:b].astype(np.int64) for a, b in zip(ends - sizes, ends, strict=True)]
            self.first = [np.cumsum(_ONES[m]) - _ONES[m] for m in self.maps]
            self.values = np.frombuffer(values, dtype=np.int64)

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The node of a quadrant one level below; -1 where it is all zero."""
        if not self.full:
            return node
        held = self.maps[level][node]
        below = self.first[level][node] + _ONES[held & ((1 << quadrant) - 1)]
        return np.where((node >= 0) & (held >> quadrant & 1 == 1), below, -1)

    def leaf(self, node: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.where(node >= 0, self.values[node], self.zero[row]) if self.full else self.zero[row]


def _cost(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def zero_costs(x: Side, y: Side) -> np.ndarray:
    """What a column costs in which neither row of a pair has an occurrence."""
    return _cost(x.zero[:, None], y.zero[None, :])


def joint_costs(x: Side, y: Side, same: bool) -> np.ndarray:
    """By row pair: what the columns with an occurrence on either side cost more than zero ones.

    ``same``: both sides are one block, so only pairs of a row and a later one count.
    """
    n, m = len(x.zero), len(y.zero)
    base, total = zero_costs(x, y), np.zeros(n * m)
    root = lambda side: np.zeros(1, dtype=np.int64) if side.full else np.full(1, -1, dtype=np.int64)
    none = np.zeros(1, dtype=np.int64)
    stack = [(0, root(x), root(y), none, none)] if x.full or y.full else []
    while stack:
        level, *pair = stack.pop()
        if len(pair[0]) > FRONTIER:
            half = len(pair[0]) // 2
            stack += [(level, *(v[:half] for v in pair)), (level, *(v[half:] for v in pair))]
            continue
        a, b, row, other = pair
        if level == LEVELS:
            if same:
                a, b, row, other = (v[row < other] for v in pair)
            more = _cost(x.leaf(a, row), y.leaf(b, other)) - base[row, other]
            total += np.bincount(row * m + other, weights=more, minlength=n * m)  # exact: below 2^53
            continue
        below, left = [], LEVELS - level - 1
        for column in (0, 1):
            down = [(y.child(level, b, 2 * s + column), 2 * other + s) for s in (0, 1)]
            for r in (0, 1):
                over, up = x.child(level, a, 2 * r + column), 2 * row + r
                for under, across in down:
                    keep = ((over >= 0) | (under >= 0)) & (up << left < n) & (across << left < m)
                    if same:
                        keep &= up <= across
                    below.append(tuple(v[keep] for v in (over, under, up, across)))
        nodes = [np.concatenate(v) for v in zip(*below, strict=True)]
        if len(nodes[0]):
            stack.append((level + 1, *nodes))
    return total.astype(np.int64).reshape(n, m)


def _tiles(cells: DataFrame) -> DataFrame:
    def tile(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sizes, maps, values = build_tree(group["row"].to_numpy(), group["col"].to_numpy(), group["p"].to_numpy())
        return pd.DataFrame([(*key, sizes, maps, values)], columns=["lang", "rows", "cols", "sizes", "maps", "leaves"])

    return cells.groupBy("lang", "rows", "cols").applyInPandas(
        tile, "lang string, rows long, cols long, sizes array<int>, maps binary, leaves binary")


_PRICED = "lang string, a string, b string, part long"


def _price(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parts of the sums of all row pairs of two sides; of the whole matrix as a zero quadrant where cols is NULL."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            x, y = (Side(zero, sizes, maps, leaves) for zero, sizes, maps, leaves in (
                (r.x_zero, r.x_sizes, r.x_maps, r.x_leaves), (r.y_zero, r.y_sizes, r.y_maps, r.y_leaves)))
            same = r.x_rows == r.y_rows
            parts = zero_costs(x, y) * r.v if r.whole else joint_costs(x, y, same)
            shown = np.ones(parts.shape, dtype=bool) if r.whole else parts != 0
            a, b = np.nonzero(np.triu(shown, 1) if same else shown)
            for at in range(0, len(a), 1 << 16):
                i, j = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
                yield pd.DataFrame({"lang": r.lang, "a": np.asarray(r.x_names, dtype=object)[i],
                                    "b": np.asarray(r.y_names, dtype=object)[j], "part": parts[i, j]})


def _pair_values(row_blocks: DataFrame, col_blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each pair of groups, one way round."""
    grid = row_blocks.join(col_blocks, "lang")
    sides = grid.join(tiles, ["lang", "rows", "cols"], "left").select(
        "lang", "cols", "v", "rows", "zero", "names", "sizes", "maps", "leaves", F.lit(False).alias("whole"))
    whole = row_blocks.select("lang", F.lit(-1).cast("long").alias("cols"), "v", "rows", "zero", "names",
                              F.lit(None).cast("array<int>").alias("sizes"), F.lit(None).cast("binary").alias("maps"),
                              F.lit(None).cast("binary").alias("leaves"), F.lit(True).alias("whole"))
    sides = written(sides.unionByName(whole), "divergence-sides")
    own = ["rows", "zero", "names", "sizes", "maps", "leaves"]
    x, y = (sides.select("lang", "cols", *(["v", "whole"] if s == "x" else []), *[F.col(c).alias(f"{s}_{c}") for c in own])
            for s in "xy")
    pairs = x.join(y, ["lang", "cols"]).where("x_rows <= y_rows")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(tasks, "lang", "cols", "x_rows", "y_rows").mapInPandas(_price, _PRICED) \
        .groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank."""
    # What is not kept goes as soon as a term's counts stand together; rows without a term stand for their group.
    of = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"all_docs": F.sum("docs").over(of), "all_n": F.sum("n").over(of)})
    counts = written(counts.where(F.col("term").isNull() | (F.col("all_docs") >= MIN_DOCS))
                     .select("lang", "source", "term", "n", "all_n"), "divergence-counts")
    held = counts.where("term IS NOT NULL")
    terms = held.groupBy("lang", "term").agg(F.max("all_n").alias("all_n"))
    size = written(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("total")), "divergence-sizes")
    columns = written(_placed(terms.join(size, "lang"), "v", "term", [F.desc("all_n"), F.col("term")], "cols", "col"), "divergence-columns")
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = counts.where("term IS NULL").select("lang", "source")
    width = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = groups.join(width, "lang").join(size.select("lang", "v"), "lang", "left").join(sums, ["lang", "source"], "left") \
        .na.fill(0, ["v", "own"]).withColumn("base", F.col("own") + 2 * F.col("v"))
    groups = written(_placed(groups, "sources", "source", [F.col("source")], "rows", "row"), "divergence-groups")

    cells = held.select("lang", "source", "term", "n") \
        .join(columns.select("lang", "term", "cols", "col",
                             share(F.col("all_n") + 2, F.col("total") + 2 * F.col("v")).alias("q")), ["lang", "term"]) \
        .join(groups.select("lang", "source", "rows", "row", "base"), ["lang", "source"]) \
        .withColumn("p", share(F.col("n") + 2, F.col("base")))
    cells = written(cells.select("lang", "source", "term", "rows", "row", "cols", "col", "p", "q"), "divergence-cells")

    zero = F.when(F.col("v") > 0, share(F.lit(2), F.when(F.col("v") > 0, F.col("base")))).otherwise(F.lit(1))
    row_blocks = groups.withColumn("zero", zero).groupBy("lang", "v", "rows").agg(
        F.sort_array(F.collect_list(F.struct("row", "zero", "source"))).alias("g")) \
        .select("lang", "v", "rows", F.col("g.zero").alias("zero"), F.col("g.source").alias("names"))
    values = written(_pair_values(row_blocks, columns.select("lang", "cols").distinct(), _tiles(cells)), "divergence-pairs")
    both = values.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        .alias("e"), "value").select("lang", "e.source", "e.item", "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    above = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), cost(F.col("p"), F.col("q")).alias("value"))
    term = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP_TERMS).withColumn("part", F.lit("term"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*names).unionByName(term.select(*names))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
occurrence AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM occurrence GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
counted AS (
  SELECT lang, source, term, count(*) AS n FROM occurrence SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (
  SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS total
  FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
grp AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS own
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counted c USING (lang, source) GROUP BY g.lang, g.source),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.own + 2 * s.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (s.total + 2 * s.v) AS q
  FROM grp g JOIN size s USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0) AS value
  FROM grp g JOIN grp o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN summed s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
above AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM cell WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM above))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""
