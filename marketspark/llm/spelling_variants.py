"""Operator 13: spelling variants by a variable-length gram index.

1. Words are counted.  A task numbers the words it sees and keeps counts, so
   what is shuffled is one row per distinct word and task.
2. The gram dictionary is pruned by frequency: a gram of ``QMIN`` to
   ``QMAX`` - 1 code points that stands at more than ``LIST`` places (and more
   than the ``MAX_PREFIXES``-th part of all places, which bounds the
   dictionary) is too frequent to be a gram of its own and is extended.
3. A word, with a mark at either end, is decomposed into one gram at each
   position: the shortest one of at least ``QMIN`` code points that is not in
   that list, ``QMAX`` at most.  Whether a gram ends is told by its own code
   points alone, so an edit changes the grams that hold its place and no other.
4. A word's bound is the largest number of its grams that hold one place.  Two
   words one edit apart share all grams but those, hence at least
   max(grams - bound) of both.  So each word merges only the lists of its
   bound + 1 rarest grams; the others can't be the only ones in common.  Lists
   are held by gram, length and position, the position being shifted by one
   behind an insertion.
5. Words that meet in a list are skipped where the parities of their code
   points differ in more places than one edit can make them, and the rest are
   verified by their edit distance.

Runs are maximal matches of ``[A-Za-z\\u00C0-\\u00FF]+``, and A-Z alone are
lower-cased.  Of a run whose unsigned crc32 of ``<doc_id>:<run>`` is divisible
by ``NOISE`` the code point at crc32 % length is deleted.

Defined cases: NULL or wordless text has no words; a NULL doc_id reads as
empty; repeated rows count each; words and texts of any length are read whole;
of variants with equal counts the smallest in code-point order is the form; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import blocks, id_and_text, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NOISE, MIN_LENGTH, MIN_COUNT = 97, 5, 3
QMIN, QMAX = 2, 4
LIST, MAX_PREFIXES = 64, 1 << 16
START, END = "^", "$"
#: Distinct words that a task holds before it hands its counts on.
HELD = 400_000
#: Runs of up to so many bytes have their checksum put together from tables.
SHORT = 48


class Numbered(dict):
    """Numbers words in the order of their first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a running checksum, being b, contributes after n more bytes."""
    tables = np.zeros((SHORT + 1, 4, 256), dtype=np.uint32)
    for n in range(SHORT + 1):
        zeros = b"\0" * n
        tables[n] = [[zlib.crc32(zeros, b << (8 * k)) ^ zlib.crc32(zeros) for b in range(256)] for k in range(4)]
    return tables


class _Counts:
    """Word counts of one task."""

    def __init__(self) -> None:
        self.shift = _shift_tables()
        self.clear()

    def clear(self) -> None:
        self.ids = Numbered()
        self.names: list[str] = []
        self.crc = np.zeros(0, dtype=np.uint32)
        self.size = np.zeros(0, dtype=np.int64)
        self.n = np.zeros(0, dtype=np.int64)
        self.altered: Counter[str] = Counter()

    def add(self, doc_ids: list[str], texts: list[str]) -> None:
        runs = [RUN.findall(t.encode().lower().decode()) for t in texts]
        lengths = [len(r) for r in runs]
        ids = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(runs)), dtype=np.int64, count=sum(lengths))
        new = list(self.ids)[len(self.names):]
        data = [w.encode() for w in new]
        self.names += new
        self.crc = np.concatenate([self.crc, np.array([zlib.crc32(b) for b in data], dtype=np.uint32)])
        self.size = np.concatenate([self.size, np.array([len(b) for b in data], dtype=np.int64)])
        self.n = np.concatenate([self.n, np.zeros(len(new), dtype=np.int64)])
        prefixes = [f"{i}:".encode() for i in doc_ids]
        doc = np.repeat(np.arange(len(texts)), lengths)
        before = np.array([zlib.crc32(p) for p in prefixes], dtype=np.uint32)[doc]
        size = self.size[ids]
        near = np.minimum(size, SHORT)
        crc = self.crc[ids]
        for k in range(4):
            crc = crc ^ self.shift[near, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(size > SHORT):
            crc[i] = zlib.crc32(self.names[ids[i]].encode(), int(before[i]))
        noisy = crc % np.uint32(NOISE) == 0
        self.n += np.bincount(ids[~noisy], minlength=len(self.names))
        for i in np.flatnonzero(noisy):
            word = self.names[ids[i]]
            at = int(crc[i]) % len(word)
            self.altered[word[:at] + word[at + 1:]] += 1

    def rows(self) -> pd.DataFrame:
        # A run may be altered to a word that stands elsewhere as it is; Spark adds the counts up.
        found = [(w, n) for w, n in chain(zip(self.names, self.n.tolist(), strict=True), self.altered.items())
                 if n and len(w) >= MIN_LENGTH]
        self.clear()
        return pd.DataFrame(found, columns=["word", "n"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = _Counts()
    for batch in batches:
        ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
        for a, b in blocks(texts):
            counts.add(ids[a:b], texts[a:b])
            if len(counts.names) > HELD:
                yield counts.rows()
    if counts.names:
        yield counts.rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of at least MIN_LENGTH code points and MIN_COUNT occurrences."""
    d = id_and_text(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= MIN_COUNT)


def gram_dictionary(words: DataFrame) -> set[str]:
    """The grams that are too frequent to stand alone; at most MAX_PREFIXES of each length."""
    marked = words.select(F.concat(F.lit(START), "word", F.lit(END)).alias("w"))
    places = marked.agg(F.sum(F.length("w"))).first()[0] or 0
    least = max(LIST, places // MAX_PREFIXES)
    starts = marked.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("p"))
    grams = starts.select(F.explode(F.array(*[F.expr(f"substring(w, p, {q})") for q in range(QMIN, QMAX)])).alias("gram"))
    return {r.gram for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).collect()}


def decompose(word: str, frequent: set[str]) -> tuple[list[str], int]:
    """The gram at each position of the marked word, and the most grams that one edit can change."""
    w = START + word + END
    grams, holding = [], [0] * (len(w) + 1)
    for p in range(len(w) - 1):
        end = p + QMIN
        while end - p < QMAX and end < len(w) and w[p:end] in frequent:
            end += 1
        grams.append(w[p:end])
        holding[p] += 1
        holding[end] -= 1
    held = most = 0
    for p, step in enumerate(holding[:-2]):  # edits are made before the end mark
        held += step
        if p:
            most = max(most, held)
    return grams, most


def _decomposed(word: Column, frequent: set[str]) -> Column:
    @F.pandas_udf("grams array<string>, bound int, parity long")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [decompose(w, frequent) for w in batch]
            yield pd.DataFrame({"grams": [g for g, _ in found], "bound": [b for _, b in found],
                                "parity": [_parity(w) for w in batch]})

    return split(word)


def _parity(word: str) -> int:
    """63 bits: whether an odd number of code points falls on each.  An edit changes two at most."""
    bits = 0
    for c in word:
        bits ^= 1 << ord(c) % 63
    return bits


def _posts(words: DataFrame) -> DataFrame:
    """(word, n, length, parity, gram, place): the rarest grams of each word, bound + 1 of them."""
    grams = written(words.withColumn("g", _decomposed(F.col("word"), gram_dictionary(words)))
                    .select(F.monotonically_increasing_id().alias("id"), "word", "n", "g.grams", "g.bound", "g.parity"), "variant-grams")
    shared = written(grams.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram")
                     .agg(F.count(F.lit(1)).alias("words")).where("words > 1"), "variant-shared")
    places = grams.select("id", F.posexplode("grams").alias("place", "gram"))
    ranked = places.join(shared, "gram").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("words", "gram", "place"))).alias("held"))
    least = F.size("grams") - F.col("bound")
    return ranked.join(grams, "id").where(F.size("held") >= least).select(
        "word", "n", F.length("word").alias("length"), "parity",
        F.explode(F.slice("held", F.lit(1), F.size("held") - least + 1)).alias("p")).select(
        "word", "n", "length", "parity", "p.gram", "p.place")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, n_other), both ways, of all pairs that one edit tells apart."""
    posts = written(_posts(words), "variant-posts")
    key = lambda length, place: F.xxhash64("gram", length, place).alias("list")
    kept = ["word", "n", "parity"]
    left = posts.select(key(F.col("length"), F.col("place")), *kept)
    # A word is looked up among those of its length, and among those that are one shorter.
    looks = F.array(F.struct(F.col("length").alias("l"), F.col("place").alias("p"), F.lit(False).alias("longer")),
                    F.struct((F.col("length") - 1).alias("l"), F.col("place").alias("p"), F.lit(True).alias("longer")),
                    F.struct((F.col("length") - 1).alias("l"), (F.col("place") - 1).alias("p"), F.lit(True).alias("longer")))
    right = posts.select("gram", *kept, F.explode(looks).alias("k")) \
        .select(key(F.col("k.l"), F.col("k.p")), "k.longer", *kept)
    x, y = left.alias("x"), right.alias("y")
    met = x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("y.longer") | (F.col("x.word") < F.col("y.word")))
                 & (F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity"))) <= 2)
                 & (F.levenshtein("x.word", "y.word", 1) == 1))
    pairs = written(met.select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"),
                               F.col("y.n").alias("n_b")).distinct(), "variant-pairs")
    return pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))).alias("e")).select("e.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form): each round doubles the steps taken.

    A form has twice the count of its word, so chains end and have at most log2(largest count) steps.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        after = written(at.join(on, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "variant-roots")
        at = after.select("word", "root")
        if after.where("moved").limit(1).count() == 0:
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    words = written(word_counts(docs), "variant-words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("order"), "other")).alias("best"))
    formed = written(words.join(best, "word", "left").withColumn("take", -F.col("best.order") >= 2 * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("take"), F.col("best.other")).alias("form"), F.when(F.col("take"), -F.col("best.order")).alias("form_n")),
        "variant-forms")
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
