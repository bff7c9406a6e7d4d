"""Operator 1: substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of each text (32 bits, shifted by two
per byte, so the last 16 bytes decide it).  A chunk ends where the hash is the
maximum of ``REACH`` bytes to either side and the next byte starts a character;
a chunk without such a place ends after ``MAX_CHUNK`` bytes.  The rule looks at
nearby content alone, so an insertion moves the chunks behind it without
changing them.  A stretch with a period of up to ``REACH`` bytes ('the the the')
has no single maximum; it is cut at the greatest hash of a period and from there
in blocks of whole periods of ``REACH`` bytes or more.  Blocks are numbered, up to
``MAX_CHUNK`` bytes, and a number is part of the digest: of a stretch longer than
the keeper's only as much as the keeper has is a duplicate.

Chunks are compared by 64-bit digest.  The document of smallest doc_id keeps a
chunk, the chunk in all others is a duplicate (with ``within``, so is each
further place in one document); digests are counted
with a partial aggregation, so a passage of very many documents is one row per
task.  Runs of consecutive duplicate chunks are extended to both sides by the
bytes that equal the keeper's there (the first place of the chunk in it, at most
``NEAR`` bytes a side), as the ends of a passage share a chunk with other text.
A run is removed, as extended, if its chunks have ``MIN_RUN`` bytes or it holds
``MIN_WORDS`` words, so a repeated passage of that many words goes as soon as it
holds one whole chunk.  A single line that many documents share is shorter and stays.

Defined cases: NULL and empty texts have no chunk; rows that repeat a doc_id
count as one document, so the first copy stays in each of them; a NULL doc_id
comes last in the order; an empty table gives an empty result; other columns
are kept by ``remove_repeats`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import id_and_text, written

REACH, MAX_CHUNK = 24, 4096
MIN_RUN, MIN_WORDS, NEAR = 100, 50, 256
LAST_ID = (1 << 63) - 1
GEAR = np.random.RandomState(1907).randint(0, 1 << 32, size=256, dtype=np.uint64).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash at every byte (the window doubles from 1 to 16 bytes)."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        if len(h) > width:
            shifted = h[:-width] << np.uint32(2 * width)
            h = h.copy()
            h[width:] += shifted
    return h


def _ahead(h: np.ndarray, reach: int) -> np.ndarray:
    """Maximum of the ``reach`` values behind each position (0 beyond the end)."""
    padded = np.concatenate([h[1:], np.zeros(reach, dtype=h.dtype)])
    width = 1
    while 2 * width <= reach:
        padded = np.maximum(padded[:-width], padded[width:])
        width *= 2
    rest = reach - width
    return np.maximum(padded[:len(h)], padded[rest:rest + len(h)])


def _blocks_of_stretches(tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and numbers of the blocks in periodic stretches; a stretch's first end has number 0.

    ``tied`` are the places of the greatest hash of each period.
    """
    ends, numbers = [], []
    for places in np.split(tied, np.flatnonzero(np.diff(tied) > REACH) + 1):
        every = -(-REACH // int(places[1] - places[0])) if len(places) > 1 else 1
        picked = places[::every]
        size = int(picked[1] - picked[0]) if len(picked) > 1 else REACH
        ends.append(picked + 1)
        numbers.append(np.arange(len(picked)) if len(picked) < 2 else np.concatenate(
            [[0], np.arange(len(picked) - 1) % (MAX_CHUNK // size) + 1]))
    return np.concatenate(ends), np.concatenate(numbers)


def _cuts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """End offsets of the chunks of a text's bytes, the last being its length, and their numbers in a periodic stretch."""
    if not data:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    h = gear_hashes(raw)
    h[:-1][(raw[1:] & 0xC0) == 0x80] = 0  # no cut inside a character
    ahead = _ahead(h, REACH)
    top = h >= _ahead(h[::-1], REACH)[::-1]
    ends = np.flatnonzero((h > ahead) & top) + 1
    numbers = np.zeros(len(ends), dtype=np.int64)
    tied = np.flatnonzero((h == ahead) & top & (h > 0))
    if len(tied):
        more, their = _blocks_of_stretches(tied)
        ends, numbers = np.concatenate([ends, more]), np.concatenate([numbers, their])
        order = np.argsort(ends)
        ends, numbers = ends[order], numbers[order]
    if not len(ends) or ends[-1] != len(raw):
        ends, numbers = np.append(ends, len(raw)), np.append(numbers, 0)
    lengths = np.diff(ends, prepend=0)
    if lengths.max() <= MAX_CHUNK:
        return ends, numbers
    out: list[tuple[int, int]] = []
    start = 0
    for end, number in zip(ends.tolist(), numbers.tolist(), strict=True):
        while end - start > MAX_CHUNK:
            cut = start + MAX_CHUNK
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append((cut, 0))
            start = cut
        out.append((end, number))
        start = end
    return np.array([e for e, _ in out], dtype=np.int64), np.array([n for _, n in out], dtype=np.int64)


def chunk_ends(data: bytes) -> np.ndarray:
    """End offsets of the chunks of a text's bytes, the last being its length."""
    return _cuts(data)[0]


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends (byte offsets) and 64-bit digests, seeded with the number in a periodic stretch."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ends, numbers = _cuts(data)
    digest = xxhash.xxh3_64_intdigest
    starts = [0, *ends.tolist()]
    found = np.fromiter((digest(data[a:b], n) for a, b, n in zip(starts, starts[1:], numbers.tolist(), strict=False)),
                        dtype=np.uint64, count=len(ends))
    return ends, found.view(np.int64)


def chunked(docs: DataFrame) -> DataFrame:
    """Written table: row, doc_id, content (hash of the text), ends, digests."""

    @F.pandas_udf("ends array<int>, digests array<long>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [chunks(t) for t in batch]
            yield pd.DataFrame({"ends": [e.astype(np.int32) for e, _ in found], "digests": [d for _, d in found]})

    return written(id_and_text(docs).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"),
        F.xxhash64("text").alias("content"), cut("text").alias("c")).select("row", "doc_id", "content", "c.*"), "chunks")


def _runs(doc_id: int, ends: np.ndarray, digests: np.ndarray, at: list[int], holders: list[int], within: bool):
    """Runs [(start, end, holders, first, last)] of a document's duplicate chunks; first and last are chunk numbers."""
    seen: set[int] = set()
    gone: dict[int, int] = {}
    for pos, holder in sorted(zip(at, holders, strict=True)):
        d = int(digests[pos])
        if holder != doc_id or (within and d in seen):
            gone[pos] = holder
        seen.add(d)
    out = []
    for pos in sorted(gone):
        start, end = int(ends[pos - 1]) if pos else 0, int(ends[pos])
        if out and out[-1][1] == start:
            out[-1][1], out[-1][4] = end, pos
            out[-1][2].add(gone[pos])
        else:
            out.append([start, end, {gone[pos]}, pos, pos])
    # What a document repeats of itself is not extended: it could reach into the place that stays.
    edge = lambda pos: {"digest": int(digests[pos]), "holder": gone[pos]} if gone[pos] != doc_id else None
    return ([{"start": a, "end": b, "kept_in": sorted(h)} for a, b, h, _, _ in out],
            [edge(pos) for _, _, _, first, last in out for pos in (first, last)])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _extended(data: bytes, start: int, end: int, before: bytes | None, after: bytes | None) -> tuple[int, int]:
    """A run with the bytes to both sides that equal its keeper's, whole characters only."""
    a = start - _common(data[max(0, start - NEAR):start][::-1], (before or b"")[::-1])
    b = end + _common(data[end:end + NEAR], after or b"")
    while a < start and data[a] & 0xC0 == 0x80:
        a += 1
    while end < b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _removed(text: str | None, runs, near: dict[int, bytes]) -> list[tuple[int, int, list[int]]]:
    """The runs that are long enough, as extended; those that meet are one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out: list[tuple[int, int, list[int]]] = []
    for i, r in enumerate(runs):
        a, b = _extended(data, r["start"], r["end"], near.get(2 * i), near.get(2 * i + 1))
        if r["end"] - r["start"] < MIN_RUN and len(data[a:b].split()) < MIN_WORDS:
            continue
        kept_in = [int(h) for h in r["kept_in"]]
        while out and out[-1][1] >= a:
            x, y, h = out.pop()
            a, b, kept_in = min(a, x), max(b, y), sorted({*kept_in, *h})
        out.append((a, b, kept_in))
    return out


def _contexts(text: Column, digests: Column) -> Column:
    """The bytes beside the first place of each of the given chunks."""

    @F.pandas_udf("array<struct<digest: long, before: binary, after: binary>>")
    def contexts(text: pd.Series, digests: pd.Series) -> pd.Series:
        out = []
        for t, wanted in zip(text, digests, strict=True):
            data = (t or "").encode("utf-8", "surrogatepass")
            ends, found = chunks(t)
            left, beside = set(map(int, wanted)), []
            for pos, d in enumerate(found.tolist()):
                if d in left:
                    left.discard(d)
                    a, b = int(ends[pos - 1]) if pos else 0, int(ends[pos])
                    beside.append({"digest": d, "before": data[max(0, a - NEAR):a], "after": data[b:b + NEAR]})
            out.append(beside)
        return pd.Series(out, dtype=object)

    return contexts(text, digests)


_CANDIDATES = ("runs array<struct<start: int, end: int, kept_in: array<long>>>, edges array<struct<digest: long, holder: long>>")
_FOUND = "spans array<struct<start: int, end: int>>, kept_in array<long>, removed_bytes long"


def _candidates(docs: DataFrame, within: bool) -> DataFrame:
    """Written table: row, doc_id, content, n_chunks, runs and the chunks at their edges, of documents with a duplicate chunk."""
    table = chunked(docs)
    places = table.select("doc_id", "row", F.posexplode("digests").alias("pos", "digest"))
    shared = written(places.groupBy("digest").agg(F.min("doc_id").alias("holder"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1").select("digest", "holder"), "chunk-shared")
    hits = places.select("digest", "row", "pos").join(shared, "digest").groupBy("row") \
        .agg(F.collect_list("pos").alias("at"), F.collect_list("holder").alias("holders"))

    @F.pandas_udf(_CANDIDATES)
    def found(doc_id: pd.Series, ends: pd.Series, digests: pd.Series, at: pd.Series, holders: pd.Series) -> pd.DataFrame:
        both = [_runs(*x, within) for x in zip(doc_id, ends, digests, at, holders, strict=True)]
        return pd.DataFrame({"runs": [r for r, _ in both], "edges": [e for _, e in both]})

    runs = table.join(hits, "row").withColumn("f", found("doc_id", "ends", "digests", "at", "holders"))
    return written(runs.where(F.size("f.runs") > 0).select("row", "doc_id", "content", "f.*", F.size("ends").cast("long").alias("n_chunks"))
                   .dropDuplicates(["doc_id", "content"]), "chunk-runs")


def repeats(docs: DataFrame, within: bool = False) -> DataFrame:
    """doc_id, content, n_chunks, text, spans (byte offsets), kept_in, removed_bytes of documents with a removed run.

    ``within`` also removes what a document repeats of itself.
    """
    candidates = _candidates(docs, within)
    d = id_and_text(docs)
    edges = candidates.select("row", F.posexplode("edges").alias("edge", "e")).where("e IS NOT NULL").select("row", "edge", "e.*")
    wanted = edges.select("digest", "holder").distinct().groupBy("holder").agg(F.collect_list("digest").alias("digests"))
    beside = d.join(wanted, F.col("doc_id") == F.col("holder")).select(F.explode(_contexts(F.col("text"), F.col("digests"))).alias("c"))
    beside = written(beside.groupBy("c.digest").agg(F.min(F.struct("c.before", "c.after")).alias("c")).select("digest", "c.*"), "chunk-beside")
    near = edges.join(beside, "digest").select("row", "edge", F.when(F.col("edge") % 2 == 0, F.col("before")).otherwise(F.col("after")).alias("bytes")) \
        .groupBy("row").agg(F.collect_list(F.struct("edge", "bytes")).alias("near"))
    runs = candidates.join(near, "row", "left").select(
        F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id"), "content", "n_chunks", "runs", "near")

    @F.pandas_udf(_FOUND)
    def removed(text: pd.Series, runs: pd.Series, near: pd.Series) -> pd.DataFrame:
        out = [_removed(t, r, {x["edge"]: x["bytes"] for x in n} if n is not None else {})
               for t, r, n in zip(text, runs, near, strict=True)]
        return pd.DataFrame({"spans": [[{"start": a, "end": b} for a, b, _ in r] for r in out],
                             "kept_in": [sorted({h for x in r for h in x[2]}) for r in out],
                             "removed_bytes": [sum(b - a for a, b, _ in r) for r in out]})

    d = d.withColumn("content", F.xxhash64("text"))
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.content") == F.col("r.content"))
    found = d.alias("d").join(runs.alias("r"), same).select("d.doc_id", "d.content", "n_chunks", "d.text", removed("d.text", "runs", "near").alias("f"))
    return found.where("f.removed_bytes > 0").select("doc_id", "content", "n_chunks", "text", "f.*")


def _without(text: Column, spans: Column) -> Column:
    """Text without byte spans."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            data, parts, at = (t or "").encode("utf-8", "surrogatepass"), [], 0
            for x in s:
                parts.append(data[at:x["start"]])
                at = x["end"]
            out.append(b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    return cut(text, spans)


def shortened(docs: DataFrame, within: bool = False) -> DataFrame:
    """doc_id, n_chunks, n_removed, removed_bytes, spans, kept_in, text (what stays) of documents with a removed run."""
    return repeats(docs, within).select(
        "doc_id", "n_chunks", F.size("spans").cast("long").alias("n_removed"), "removed_bytes", "spans", "kept_in",
        _without(F.col("text"), F.col("spans")).alias("text"))


def remove_repeats(docs: DataFrame, within: bool = False) -> DataFrame:
    """``docs`` with the removed runs taken out of ``text``; every row and column stays."""
    names = docs.columns
    cut = written(repeats(docs, within).drop("text"), "chunk-repeats").dropDuplicates(["doc_id", "content"]) \
        .select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"), F.col("spans").alias("__spans"))
    whole = docs.select(F.struct(*names).alias("d"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("__content"))
    joined = whole.join(cut, same, "left")
    text = F.when(F.col("__spans").isNull(), F.col("d.text")).otherwise(
        _without(F.col("d.text"), F.coalesce("__spans", F.array().cast("array<struct<start: int, end: int>>"))))
    return joined.select(*[text.alias("text") if c == "text" else F.col("d")[c].alias(c) for c in names])
