"""Operator 3: MinHash near-dedup by a signature-coordinate inverted join.

1. Each document's set of distinct five-word shingles gives a MinHash
   signature of ``COORDINATES`` values, each a (coordinate, value) token, and a
   parity sketch: bit i tells whether an odd number of shingles hash to i.
   Documents with equal sets form a class, which takes part once.
2. Tokens that only one representative has can't collide; the others are joined
   back.  A pair needs ``matches`` collisions, so a representative with c
   shared tokens is posted under its c - matches + 1 rarest ones only
   (prefix); with fewer than ``matches`` shared tokens it is posted nowhere.
3. First pass: every posted document is paired with the smallest document of
   each list.  Linked pairs form components.  Second pass: documents of a list
   that are in different components are paired, in blocks of at most ``BLOCK``
   documents so that a long list is spread over many tasks; lists that lie
   within one component are skipped, so a large group of copies costs a number
   of pairs in proportion to its size.  Every cross-component pair of the lists
   is looked at, so the components are those of all pairs.
4. A pair is skipped without merging if set sizes or parity sketches rule it
   out: each shingle that only one of both sets has flips one bit, so sketches
   that differ in more bits than a link's sets may differ in shingles prove
   that there is no link.  For the rest collisions are counted by merging both
   token lists, and pairs with ``matches`` or more are confirmed on full sets.

The link threshold is ``share`` hundredths of similarity, ``SHARE`` where none
is given; ``matches`` follows from it: a pair of exactly the threshold's
similarity has fewer collisions with a probability below ``MISS``.

Shingles are compared by 64-bit hashes.  Defined cases: NULL or wordless text
has an empty set and is linked with nothing; fewer than five words are one
shingle; a row with NULL doc_id gets its class's component and is not kept; a class
without any doc_id is linked with nothing and kept; rows that repeat doc_id and text are
one document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import id_and_text, written
from marketspark.llm.components import components

WORDS, SHARE = 5, 85
COORDINATES, MISS = 32, 1e-9
#: Longs of a parity sketch.
SKETCH = 16
BLOCK = 512


def least_matches(trials: int, p: float, miss: float = MISS) -> int:
    """Largest t with P(Binomial(trials, p) < t) <= miss."""
    below, t = 0.0, 0
    while True:
        below += comb(trials, t) * p ** t * (1 - p) ** (trials - t)
        if below > miss:
            return t
        t += 1


_MASK = (1 << 64) - 1


class WordHashes(dict):
    """64-bit hashes of words, each computed once (bounded memory)."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value


_HASHES = WordHashes()
_MIX = [np.uint64(int.from_bytes(hashlib.blake2b(b"shingle%d" % i, digest_size=8).digest(), "little") | 1) for i in range(WORDS)]
_SEEDS = np.random.RandomState(20240).randint(0, 1 << 32, size=(2, COORDINATES), dtype=np.uint64).astype(np.uint32)


def _final(h: np.ndarray) -> np.ndarray:
    """Mix all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text.

    Words are separated by ASCII white space, and A-Z are lower-cased (both as
    ``bytes.split`` and ``bytes.lower`` do).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        mixed += h[i:i + n] * _MIX[i]
    return np.unique(_final(mixed))


def set_digest(s: np.ndarray) -> str:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x COORDINATES) 32-bit minima; sets are not empty."""
    flat = np.concatenate(sets)
    low = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (flat >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    minima = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    for k in range(COORDINATES):
        value = (low ^ _SEEDS[0, k]) * (_SEEDS[1, k] | np.uint32(1))
        value ^= value >> np.uint32(15)
        value *= high
        minima[:, k] = np.minimum.reduceat(value, starts)
    return minima


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH longs: parity of the shingles that hash to each bit."""
    bits = np.bincount((s % np.uint64(SKETCH * 64)).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


_SIGNED = "n_shingles long, set_digest string, tokens array<long>, sketch array<long>"


def _signed(text: Column) -> Column:
    @F.pandas_udf(_SIGNED)
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coordinate = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            sets = [shingle_set(t) for t in batch]
            n = [len(s) for s in sets]
            digest = [set_digest(s) if len(s) else None for s in sets]
            tokens: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            at = 0
            while at < len(full):  # bounded working arrays: about a million shingles at a time
                end, size = at, 0
                while end < len(full) and (end == at or size + n[full[end]] <= 1 << 20):
                    size += n[full[end]]
                    end += 1
                minima = signatures([sets[i] for i in full[at:end]])
                for row, i in enumerate(full[at:end]):
                    tokens[i], sketch[i] = coordinate | minima[row], parity_sketch(sets[i])
                at = end
            yield pd.DataFrame({"n_shingles": n, "set_digest": digest, "tokens": tokens, "sketch": sketch})

    return sign(text)


def _hashes(text: Column) -> Column:
    @F.pandas_udf("set_digest string, hashes array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch]
            yield pd.DataFrame({"set_digest": [set_digest(s) for s in sets], "hashes": [s.view(np.int64) for s in sets]})

    return hashes(text)


def _may_link(share: int) -> Column:
    """Set sizes and parity sketches of a pair (x, y) do not rule a link out."""
    differing = [F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH)]
    most = (F.col("x.n") + F.col("y.n")) * (100 - share)
    few = sum(differing[1:SKETCH // 4], differing[0])
    return ((F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * share)
            & (few * (100 + share) <= most) & (sum(differing[1:], differing[0]) * (100 + share) <= most))


def _postings(reps: DataFrame, matches: int) -> DataFrame:
    """(token, doc, n, sketch, tokens): the prefix of each representative that can link."""
    pairs = reps.select("doc", F.explode("tokens").alias("token"))
    shared = written(pairs.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1"), "near-shared")
    ranked = pairs.join(shared, "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("held"))
    prefix = ranked.where(F.size("held") >= matches).select(
        "doc", F.expr(f"slice(held.token, 1, size(held) - {matches - 1})").alias("prefix"))
    return prefix.join(reps, "doc").select("doc", "n", "sketch", F.sort_array("tokens").alias("tokens"), "prefix")


def _pair(x: str = "x", y: str = "y") -> list[Column]:
    return [F.least(f"{x}.doc", f"{y}.doc").alias("a"), F.greatest(f"{x}.doc", f"{y}.doc").alias("b")]


def _star_pairs(lists: DataFrame, share: int) -> DataFrame:
    """Each posted document with the smallest one of its list."""
    first = written(lists.groupBy("token").agg(F.min_by(F.struct("doc", "n", "sketch"), "doc").alias("f"))
                    .select("token", "f.*"), "near-first")
    return lists.alias("x").join(first.alias("y"), F.col("x.token") == F.col("y.token")) \
        .where((F.col("x.doc") != F.col("y.doc")) & _may_link(share)).select(*_pair()).distinct()


def _cross_pairs(lists: DataFrame, member: DataFrame, share: int) -> DataFrame:
    """Pairs of each list that lie in different components, by blocks of the list.

    Prefixes are in one global order, and a pair is made in the list of their
    first common token only.
    """
    labelled = written(lists.join(member.withColumnRenamed("node", "doc"), "doc", "left")
                       .withColumn("component", F.coalesce("component", "doc")), "near-labelled")
    mixed = written(labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                                  F.count(F.lit(1)).alias("n_posts"))
                    .where("low != high").select("token", F.ceil(F.col("n_posts") / BLOCK).cast("int").alias("n_blocks")),
                    "near-mixed")
    posts = written(labelled.join(mixed, "token").withColumn(
        "block", F.pmod(F.xxhash64("doc"), F.col("n_blocks")).cast("int")), "near-blocks")
    kept = ["doc", "n", "sketch", "prefix", "component"]
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    left = posts.withColumn("to_block", other).select("token", F.col("block").alias("i"), F.col("to_block").alias("j"), *kept)
    right = posts.withColumn("to_block", other).select("token", F.col("to_block").alias("i"), F.col("block").alias("j"), *kept)
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    return left.alias("x").join(right.alias("y"), same & (F.col("x.doc") < F.col("y.doc"))
                                & (F.col("x.component") != F.col("y.component")) & _may_link(share)
                                & (F.array_intersect("x.prefix", "y.prefix")[0] == F.col("x.token"))) \
        .select(*_pair()).distinct()


def _confirmed(pairs: DataFrame, posted: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) with enough collisions whose full sets are similar enough."""
    pairs = written(pairs, "near-pairs")
    counted = pairs.join(posted.select(F.col("doc").alias("a"), F.col("tokens").alias("ta")), "a") \
        .join(posted.select(F.col("doc").alias("b"), F.col("tokens").alias("tb")), "b") \
        .where(F.size(F.array_intersect("ta", "tb")) >= least_matches(COORDINATES, share / 100)).select("a", "b")
    counted = written(counted, "near-counted")
    both = counted.join(sets.select(F.col("doc").alias("a"), F.col("hashes").alias("sa")), "a") \
        .join(sets.select(F.col("doc").alias("b"), F.col("hashes").alias("sb")), "b")
    common = both.withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return common.where(F.col("common") * 100 >= union * share).select("a", "b")


def signed_documents(docs: DataFrame) -> DataFrame:
    d = id_and_text(docs).withColumn("content", F.xxhash64("text"))
    signed = d.withColumn("s", _signed(F.col("text"))).select("doc_id", "content", "s.*")
    # A document with no shingle is a class of its own.
    lone = F.concat(F.lit("empty-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return written(signed.withColumn("set_digest", F.coalesce("set_digest", lone)), "near-signed")


def representatives(signed: DataFrame) -> DataFrame:
    """One row per class with a non-empty set: doc (a number for the class), class_id (smallest doc_id), n, tokens, sketch."""
    return written(signed.where("n_shingles > 0").groupBy("set_digest").agg(
        F.min("doc_id").alias("class_id"), F.min("n_shingles").alias("n"), F.any_value("tokens").alias("tokens"),
        F.any_value("sketch").alias("sketch")).where("class_id IS NOT NULL")
        .withColumn("doc", F.xxhash64("set_digest")), "near-reps")


def links(docs: DataFrame, reps: DataFrame, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) between classes, and (node, component) of linked ones."""
    posted = written(_postings(reps, least_matches(COORDINATES, share / 100)), "near-posted")
    lists = written(posted.select(F.explode("prefix").alias("token"), "doc", "n", "sketch", "prefix"), "near-lists")
    wanted = id_and_text(docs).join(posted.join(reps.select("doc", "class_id", "set_digest"), "doc")
                                    .select(F.col("class_id").alias("doc_id"), "set_digest", "doc"), "doc_id")
    # Hashed after the join (the condition on the digest would pull the function below it).
    hashed = written(wanted.select("doc", "set_digest", _hashes(F.col("text")).alias("h")), "near-sets")
    sets = hashed.where("h.set_digest = set_digest").select("doc", "h.hashes").dropDuplicates(["doc"])
    star = written(_confirmed(_star_pairs(lists, share), posted, sets, share), "near-links")
    member = components(star)
    cross = written(_confirmed(_cross_pairs(lists, member, share), posted, sets, share), "near-links")
    every = star.unionByName(cross)
    return every, components(every)


def _marked(docs: DataFrame, share: int) -> DataFrame:
    """The columns of ``near_duplicates`` and content (hash of the text) of every row."""
    signed = signed_documents(docs)
    reps = representatives(signed)
    _, member = links(docs, reps, share)
    member = written(member, "near-members")
    least = member.join(reps, F.col("node") == F.col("doc")).groupBy("component").agg(F.min("class_id").alias("component_id"))
    linked = member.join(least, "component").select(F.col("node").alias("doc"), "component_id")
    classes = signed.where("doc_id IS NOT NULL").groupBy("set_digest").agg(F.min("doc_id").alias("class_id"))
    named = written(classes.withColumn("doc", F.xxhash64("set_digest")).join(linked, "doc", "left")
                    .select("set_digest", "class_id", F.coalesce("component_id", "class_id").alias("component_id")), "near-classes")
    return signed.select("doc_id", "content", "n_shingles", "set_digest").join(named, "set_digest", "left").select(
        "doc_id", "content", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "class_id")


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id of every row."""
    return _marked(docs, share).drop("content")


def drop_near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """Rows of ``docs`` that are kept (found again by doc_id and text), all columns kept."""
    names = docs.columns
    kept = _marked(docs, share).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("content").alias("__kept_content")).distinct()
    whole = docs.select(F.struct(*names).alias("doc"), F.col("doc_id").cast("long").alias("__id"),
                        F.xxhash64(F.col("text").cast("string")).alias("__content"))
    same = F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__content") == F.col("__kept_content"))
    return whole.join(kept, same, "left_semi").select("doc.*").select(*names)
