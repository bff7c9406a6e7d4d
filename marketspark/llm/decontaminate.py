"""Operator 6: benchmark decontamination by q-gram lemma filtering.

A document is contaminated by a benchmark item if a region of it is within an
edit budget of the whole item: ``BUDGET`` of the item's characters, less where
the lemma needs it.  Texts are compared lower-cased, every white-space
character as a space, one to one, so spans are positions in the original.

Filter: a region within ``k`` edits of an item of ``m`` characters shares at
least ``m + 1 - q (k + 1)`` of its q-grams, on diagonals at most ``k`` apart
from its own.  Diagonals are cut into bands of width 2 (2k + 1) that overlap by
half, so every such region lies wholly in one band; q-grams of an item are
counted per (document, item, band) in numpy over a batch of texts, and bands
that reach the bound are retained.  Verification: banded alignment of the whole item against
the retained band's text, free at the text's ends, gives the least number of
edits and the region.

The benchmark is a stated query set: it is written once as a table with numbered
rows, dealt by row number into blocks of about ``BLOCK_CHARS`` characters, and
every block is held against all documents, one after the other: the driver and
the tasks hold one block at a time, and what a block finds is written before the
next is read.  Documents are not shuffled.

Defined cases: NULL and empty texts contain nothing; NULL and empty items match
nothing; items shorter than ``Q`` characters have no q-gram and match a text
only as a whole; equal items are all reported; a NULL doc_id is kept; rows that
repeat are reported each; empty tables give an empty result; other columns and
clashing names don't matter (``drop_contaminated`` keeps them).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import blocks, id_and_text, written

Q, BUDGET = 10, 0.08
BLOCK_CHARS = 2 << 20
FILTER_BITS = 22
#: Pairs of a place in a text and one in an item that are counted at once.
PLACES = 1 << 21
MATCHES = "array<struct<item_id: long, start: int, end: int, edits: int>>"

_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Compared form of each code point: lower case where that is one character, white space as space."""
    if not _FOLD:
        table = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isspace():
                table[i] = 32
            elif len(low := c.lower()) == 1 and low != c:
                table[i] = ord(low)
        _FOLD.append(table)
    return _FOLD[0]


def folded(text: str) -> np.ndarray:
    return fold_table().take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"))


def rolling(points: np.ndarray, q: int = Q) -> np.ndarray:
    """32-bit polynomial hash of the q-gram at each position (empty if there is none)."""
    if len(points) < q:
        return np.zeros(0, dtype=np.uint32)
    power = 0x9E3779B1
    h = points * np.uint32(0x85EBCA6B)
    n = len(points) - q + 1
    total, width, at = None, 1, 0
    rest = q
    while rest:  # binary doubling of the window
        if rest & 1:
            part = h[at:at + n]
            total = part if total is None else total * np.uint32(power) + part
            at += width
        rest >>= 1
        if rest:
            h = h[:-width] * np.uint32(power) + h[width:]
            width *= 2
            power = power * power & 0xFFFFFFFF
    return total


_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(Q)], dtype=np.uint64)


def exact_grams(points: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """64-bit hashes of the q-grams at some positions."""
    h = np.zeros(len(positions), dtype=np.uint64)
    for i in range(Q):
        h += points[positions + i].astype(np.uint64) * _POWERS[i]
    return h ^ (h >> np.uint64(29))


def _slices(n: np.ndarray) -> Iterator[slice]:
    """Consecutive slices in which ``n`` adds up to about PLACES."""
    ends = np.flatnonzero(np.diff(np.cumsum(n) // PLACES)) + 1
    for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(n)], strict=True):
        yield slice(a, b)


class Block:
    """Index of some items: sorted q-grams with their (item, offset) places, and a bit filter."""

    def __init__(self, items: list[tuple[int, str]]):
        self.short = [(i, folded(t)) for i, t in items if t and len(t) < Q]
        items = [(i, t) for i, t in items if t and len(t) >= Q]
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.points = [folded(t) for _, t in items]
        m = np.array([len(p) for p in self.points], dtype=np.int64)
        # The lemma's bound is at least 1.
        self.budget = np.minimum((m * BUDGET).astype(np.int64), (m + 1) // Q - 1 - ((m + 1) % Q == 0))
        self.budget = np.maximum(self.budget, 0)
        self.bound = np.maximum(m + 1 - Q * (self.budget + 1), 1)
        self.step = 2 * self.budget + 1
        self.length = m
        grams = [exact_grams(p, np.arange(len(p) - Q + 1)) for p in self.points]
        coarse = [rolling(p) for p in self.points]
        self.coarse = np.unique(np.concatenate(coarse)) if coarse else np.zeros(0, dtype=np.uint32)
        flat = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat))
        #: Least band width of the items that hold a q-gram.
        self.reach = np.minimum.reduceat(self.step[self.item], self.first) if len(flat) else np.zeros(0, dtype=np.int64)

    def ready(self) -> Block:
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.coarse >> np.uint32(32 - FILTER_BITS)] = True
        return self

    def retained(self, points: np.ndarray) -> list[tuple[int, int]]:
        """(item index, band) of every band that reaches its item's bound."""
        coarse = rolling(points)
        if not len(coarse) or not len(self.grams):
            return []
        pos = np.flatnonzero(self.filter.take(coarse >> np.uint32(32 - FILTER_BITS)))
        hashes = exact_grams(points, pos)
        found = np.searchsorted(self.grams, hashes)
        found[found == len(self.grams)] = 0
        hit = self.grams[found] == hashes
        pos, found = pos[hit], found[hit]
        if not len(pos):
            return []
        # Of the places of a q-gram that lie within the least band width of its items, the first and the last are
        # on all the diagonal bands that the others are on, whatever its offset in an item.
        cell = pos // self.reach[found]
        order = np.lexsort((pos, found))
        pos, found, cell = pos[order], found[order], cell[order]
        new = np.concatenate([[True], (found[1:] != found[:-1]) | (cell[1:] != cell[:-1])])
        ends = np.flatnonzero(new | np.append(new[1:], True))
        pos, found = pos[ends], found[ends]
        longest = int(self.length.max())
        low = min(0, int(pos.min()) - longest) - 1
        span = int(pos.max()) - low + 2
        out: list[tuple[int, int]] = []
        for first, last, place_item, place_offset in self._item_groups(found):
            keys = [self._keys(pos[at], found[at], first, last, place_item, place_offset, low, span, longest)
                    for at in _slices((last - first)[found])]
            # The item's q-grams count, not their repeats in the text.
            held, counts = np.unique(np.unique(np.concatenate(keys)) // longest, return_counts=True)
            good = counts >= self.bound[held // span]
            out += [(int(k // span), int(k % span + low)) for k in held[good]]
        return sorted(out)

    def _item_groups(self, found: np.ndarray):
        """(first, last, item, offset): the places of each q-gram, for some items at a time.

        Items are taken together up to about ``PLACES`` pairs of a place in the text and one in an item.
        """
        uses = np.bincount(found, minlength=len(self.grams))
        pairs = np.bincount(self.item, weights=np.repeat(uses, self.last - self.first), minlength=len(self.ids))
        part = (np.cumsum(pairs) // PLACES).astype(np.int64)
        parts = np.unique(part[pairs > 0])
        if len(parts) == 1:
            yield self.first, self.last, self.item, self.offset
            return
        of = part[self.item]
        for g in parts:
            held = of == g
            before = np.concatenate([[0], np.cumsum(held)])
            yield before[self.first], before[self.last], self.item[held], self.offset[held]

    def _keys(self, pos, found, first, last, place_item, place_offset, low, span, longest) -> np.ndarray:
        """Distinct (item, wide band, offset) of some places in the text, as one number each."""
        n = last[found] - first[found]
        place = np.repeat(first[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, offset = place_item[place], place_offset[place]
        band = (np.repeat(pos, n) - offset) // self.step[item]
        # A q-gram on diagonal band b counts for the wide bands b - 1 and b.
        key = np.unique((item * span + (band - low)) * longest + offset)
        return np.concatenate([key, key - longest])

    def search(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of each contaminated region, the best per overlap."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for i, band in self.retained(points):
            k, m, w = int(self.budget[i]), int(self.length[i]), int(self.step[i])
            a, b = max(0, band * w - k), min(len(points), (band + 2) * w + m + k)
            if hit := align(self.points[i], points[a:b], k, band * w - a):
                out.setdefault(i, []).append((hit[2], hit[0] + a, hit[1] + a))
        found = [(int(i), 0, len(points), 0) for i, p in self.short if len(p) == len(points) and (p == points).all()]
        for i, regions in out.items():
            taken: list[tuple[int, int]] = []  # in order, without overlaps
            for edits, a, b in sorted(regions):
                at = bisect_left(taken, (a, b))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                    taken.insert(at, (a, b))
                    found.append((int(self.ids[i]), a, b, edits))
        return sorted(found)


def _best_end(item: np.ndarray, text: np.ndarray, k: int, low: int, width: int) -> tuple[int, int]:
    """Least edits, and the first end position, of ``item`` in ``text`` on diagonals low .. low + width - 1.

    Row i holds the edits of item[:i] ending at text position low + i + j; a
    diagonal outside the text costs too much.
    """
    far = len(item) + len(text) + 1
    lane = np.arange(width)
    start = low + lane
    row = np.where((start >= 0) & (start <= len(text)), 0, far)
    padded = np.append(text.astype(np.int64), -1)
    for i, c in enumerate(item.tolist(), 1):
        end = low + i + lane
        inside = (end >= 0) & (end <= len(text))
        before = np.where((end >= 1) & (end <= len(text)), end - 1, len(text))
        step = row + (padded[before] != c)
        step[end < 1] = far
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        step[~inside] = far
        row = np.minimum.accumulate(step - lane) + lane
        row[~inside] = far
    j = int(row.argmin())
    return int(row[j]), low + len(item) + j


def align(item: np.ndarray, text: np.ndarray, k: int, first: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence of ``item`` within ``k`` edits, or None.

    Diagonals from ``first`` - k to 2 (2k + 1) + k behind it are aligned.
    """
    width = 2 * (2 * k + 1) + 2 * k + 1
    whole, part = text.tobytes(), item.tobytes()
    at = whole.find(part)
    while at >= 0 and at % 4:
        at = whole.find(part, at + 1)
    if at >= 0:  # no edit: nothing to align
        return at // 4, at // 4 + len(item), 0
    edits, end = _best_end(item, text, k, first - k, width)
    if edits > k:
        return None
    # The same from the end backwards finds the start.
    tail = text[:end][::-1]
    _, back = _best_end(item[::-1], tail, k, -k, 2 * k + 1)
    return end - back, end, edits


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[Block, bool]]:
    """The benchmark in blocks of about BLOCK_CHARS characters (and an item), each with whether it is the last.

    Rows are dealt by a hash of their number in the written table, so rows that repeat are spread as well.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")) \
        .where("text IS NOT NULL AND item_id IS NOT NULL AND text != ''")
    items = written(rows.withColumn("row", F.monotonically_increasing_id()), "benchmark-items")
    n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)
    for i in range(n):
        held = items.where(F.pmod(F.xxhash64("row"), F.lit(n)) == i).orderBy("row").collect()
        yield Block([(r["item_id"], r["text"]) for r in held]), i == n - 1


def _block_matches(text: Column, block: Block) -> Column:
    @F.pandas_udf(MATCHES)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = block.ready()
        for batch in batches:
            out: list[list[dict]] = []
            texts = batch.fillna("").tolist()
            for a, b in blocks(texts, 1 << 18):
                points = [folded(t) for t in texts[a:b]]
                suspects = _suspects(ready, points)
                for i, p in enumerate(points):
                    hits = ready.search(p) if suspects[i] else []
                    out.append([{"item_id": x, "start": s, "end": e, "edits": n} for x, s, e, n in hits])
            yield pd.Series(out, dtype=object)

    return search(text)


def _suspects(block: Block, points: list[np.ndarray]) -> np.ndarray:
    """Whether a text can hold an item: bands are counted over the joined texts of a batch.

    A code point beyond Unicode parts the texts, so no q-gram crosses; a text
    is looked at on its own if a retained band touches it.
    """
    out = np.zeros(len(points), dtype=bool)
    short = {len(p) for _, p in block.short}
    gap = np.full(1, 0x110000, dtype=np.uint32)
    joined = np.concatenate([x for p in points for x in (p, gap)]) if points else gap
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in points])])
    for i, band in block.retained(joined):
        a = band * int(block.step[i])
        b = a + 2 * int(block.step[i]) + int(block.length[i])
        first = max(0, int(np.searchsorted(starts, a, "right")) - 1)
        out[first:int(np.searchsorted(starts, b, "left"))] = True
    return out | np.array([len(p) in short for p in points], dtype=bool)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits of every contaminated region."""
    d = id_and_text(docs)
    found = d.where(F.lit(False)).select("doc_id", F.explode(F.array().cast(MATCHES)).alias("m")).select("doc_id", "m.*")
    for block, last in item_blocks(benchmark):
        hits = d.select("doc_id", F.explode(_block_matches(F.col("text"), block)).alias("m")).select("doc_id", "m.*")
        found = found.unionByName(hits if last else written(hits, "leaks"))
    return found.select("doc_id", "item_id", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "edits")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, with all columns."""
    names = docs.columns
    for block, last in item_blocks(benchmark):
        whole = docs.select(F.struct(*names).alias("doc"), F.col("text").cast("string").alias("text"))
        docs = whole.withColumn("found", _block_matches(F.col("text"), block)).where("size(found) = 0") \
            .select("doc.*").select(*names)
        if not last:
            docs = written(docs, "clean")
    return docs
