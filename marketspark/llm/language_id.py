"""Operator 9: language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text recognises every substring of
it.  A document is parsed greedily against each automaton: the longest prefix
that occurs in the labelled text is one phrase, then parsing goes on behind it.
Text in a language needs few, long phrases against that language's automaton;
the language with the fewest phrases per symbol wins (ties: the alphabetically
first).  ``score`` is the margin ``1 - fewest / second fewest`` (1 with a single
language; 0 on a tie).

Texts are lower-cased and reduced to letters and one separator per run of
other characters.  Documents are cut into lanes of ``LANE`` symbols (a phrase
ends at a lane's end, alike for every language), and all lanes and languages
of a batch step through one transition table together.

The training sample is bounded: per language at most ``TRAIN_DOCS`` documents
(those of smallest hash; documents over ``TRAIN_CHARS`` characters only after all
others, and of them the first ``TRAIN_CHARS``) and together at most ``TRAIN_SYMBOLS`` symbols, or an
equal part of ``TOTAL_SYMBOLS`` where many languages are labelled.  Automata
have at most two states and three edges per symbol, and the table sent to the
tasks is of edges where one of states x symbols would be large.

Defined cases: NULL text or text without a letter gives ``und`` with score 0,
as does a training set without any labelled letter; a NULL doc_id counts as
empty text in the fold rule; repeated rows give repeated results; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import blocks

UNDETERMINED = "und"
TRAIN_DOCS, TRAIN_CHARS, TRAIN_SYMBOLS, TOTAL_SYMBOLS = 48, 16_384, 40_000, 400_000
LANE = 256
#: States x symbols up to which a table has an entry for each (128 MB); places tried for a state's edges beyond that.
DENSE_ENTRIES, TRIES = 1 << 25, 64
RESULT = "lang_pred string, score double"


def held_out(doc_id: Column) -> Column:
    """Fold rule: crc32 of the doc_id as text leaves remainder 2 on division by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence (state 0 is its root)."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        current = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = current
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[current] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    return edges


_LETTERS: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class CrossParser:
    """Automata of all languages in one transition table.

    Symbols: 0 pads a lane (every state keeps itself), 1 separates, 2 is a
    letter that no labelled text has, further ones are letters.  State 0 means
    that no phrase is under way (or none can go on).  Up to ``DENSE_ENTRIES`` states x symbols there is an entry
    for each, premultiplied by the alphabet size; beyond that, as with thousands of letters, edges only are held.
    """

    def __init__(self, texts: dict[str, list[str]], symbols: int = TRAIN_SYMBOLS, total: int = TOTAL_SYMBOLS):
        self.languages = sorted(texts)
        per_language = min(symbols, total // max(1, len(self.languages)))
        cleaned = {}
        for lang in self.languages:
            points = [code_points(t.lower()) for t in texts[lang]]
            points = np.concatenate([np.append(p, 0x20).astype("<u4") for p in points]) if points else np.zeros(0, "<u4")
            cleaned[lang] = self._squeeze(np.where(is_letter()[points], points, 0))[:per_language]
        letters = sorted({int(c) for p in cleaned.values() for c in np.unique(p)} - {0})
        self.letters, self.size = np.array(letters, dtype=np.int64), 3 + len(letters)
        code = {0: 1} | {c: 3 + i for i, c in enumerate(letters)}
        edges: list[dict[int, int]] = [{}]
        roots = []
        for lang in self.languages:
            base = len(edges)
            roots.append(base)
            own = suffix_automaton([code[int(c)] for c in cleaned[lang]])
            edges.extend({c: t + base for c, t in e.items()} for e in own)
        if len(edges) * self.size <= DENSE_ENTRIES:
            table = np.zeros((len(edges), self.size), dtype=np.int32)
            for state, e in enumerate(edges):
                for c, t in e.items():
                    table[state, c] = t * self.size
            table[:, 0] = np.arange(len(edges)) * self.size
            self.table, self.roots = table.ravel(), np.array(roots, dtype=np.int32) * self.size
        else:
            self.table, self.roots = None, np.array(roots, dtype=np.int32)
            self._displace(edges)

    def _displace(self, edges: list[dict[int, int]]) -> None:
        """Edges of all states in one list: that of (state, symbol) is at ``base[state] + symbol`` if ``owner`` says so.

        States are laid over each other where their edges leave room, so the list
        is about as long as there are edges, at most three times the symbols.
        """
        slots = sum(len(e) for e in edges)
        used = bytearray(b"\1" * self.size + b"\0" * (slots + 2 * self.size))
        base = np.zeros(len(edges), dtype=np.int64)
        free = self.size
        for state in sorted(range(len(edges)), key=lambda s: -len(edges[s])):
            symbols = sorted(edges[state])
            if not symbols:
                continue
            at = free = used.find(0, free)
            for _ in range(TRIES):
                if not any(used[at - symbols[0] + c] for c in symbols):
                    break
                at = used.find(0, at + 1)
            else:
                at = max(used.rfind(1) + 1, self.size)  # behind all others
            base[state] = at - symbols[0]
            if (need := at + 3 * self.size) > len(used):
                used.extend(bytes(need + len(used) // 8 - len(used)))
            for c in symbols:
                used[base[state] + c] = 1
        size = used.rfind(1) + 1 + self.size
        self.base = base.astype(np.int32)
        self.owner, self.target = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for state, e in enumerate(edges):
            for c, t in e.items():
                self.owner[base[state] + c], self.target[base[state] + c] = state, t

    def _follow(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state behind a symbol, 0 where there is none; a padding symbol keeps the state."""
        if self.table is not None:
            return self.table.take(state + symbols)
        at = self.base.take(state) + symbols
        return np.where(symbols == 0, state, np.where(self.owner.take(at) == state, self.target.take(at), 0))

    @staticmethod
    def _squeeze(points: np.ndarray) -> np.ndarray:
        """One separator (0) per run of them."""
        if not len(points):
            return points
        keep = points != 0
        keep[0] = True
        keep[1:] |= points[:-1] != 0
        return points[keep]

    def ready(self) -> CrossParser:
        """Lookup of each code point's symbol (made in the task, not sent)."""
        self.symbol_of = np.where(is_letter(), 2, 1).astype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.symbol_of[self.letters] = np.arange(3, self.size)
        return self

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts (texts x languages) and whether each text has a letter."""
        lanes, owner = [], []
        lettered = np.zeros(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            s = self.symbol_of[code_points(text.lower())]
            if not len(s):
                continue
            keep = s != 1
            lettered[i] = keep.any()
            keep[0] = True
            keep[1:] |= s[:-1] != 1
            s = s[keep]
            n = -(-len(s) // LANE)
            padded = np.zeros(n * LANE, dtype=self.symbol_of.dtype)
            padded[:len(s)] = s
            lanes.append(padded.reshape(n, LANE))
            owner.append(np.full(n, i))
        counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not lanes or not self.languages:
            return counts, lettered
        steps = np.ascontiguousarray(np.concatenate(lanes).T).astype(np.int32)
        owner = np.concatenate(owner)
        width = steps.shape[1]
        state = np.zeros((len(self.languages), width), dtype=np.int32)  # no phrase under way
        cut = np.zeros(state.shape, dtype=np.int32)
        for symbols in steps:
            follow = self._follow(state, symbols)
            dead = (follow == 0) & (symbols > 0)
            cut += dead
            # A new phrase starts with this symbol; one that no labelled text has is a phrase of its own (state 0).
            np.copyto(follow, self._follow(self.roots[:, None], symbols), where=dead)
            state = follow
        for k in range(len(self.languages)):
            counts[:, k] = np.bincount(owner, weights=cut[k], minlength=len(texts))
        return counts, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        counts, lettered = self.phrases(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        best = counts.argmin(axis=1)
        ranked = np.sort(counts, axis=1).astype(float)
        score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1) if len(self.languages) > 1 else np.ones(len(texts))
        return ([self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)],
                np.where(lettered, score, 0.0).tolist())


def train(docs: DataFrame, label_col: str = "lang") -> CrossParser:
    """Automata from the bounded sample of labelled documents outside the held-out fold."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                    F.col(label_col).cast("string").alias("label"))
    d = d.where(F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
                & (F.col("text") != ""))
    # Ids first: the rank sorts narrow rows, and its partial limit leaves few of them to shuffle.
    order = Window.partitionBy("label").orderBy("long", F.xxhash64("doc_id", F.lit("language-sample")), "doc_id")
    chosen = d.select("label", "doc_id", (F.length("text") > TRAIN_CHARS).alias("long")).withColumn("rank", F.row_number().over(order)) \
        .where(F.col("rank") <= TRAIN_DOCS).select("label", "doc_id").collect()
    texts: dict[str, list[str]] = {r["label"]: [] for r in chosen}
    ids = {r["doc_id"] for r in chosen}
    known = sorted(i for i in ids if i is not None)
    pick = F.col("doc_id").isin(known) if known else F.lit(False)
    if None in ids:
        pick = pick | F.col("doc_id").isNull()
    bounded = d.where(pick).withColumn("text", F.substring("text", 1, TRAIN_CHARS))
    for r in sorted(bounded.distinct().orderBy("label", "doc_id", "text").limit(2 * TRAIN_DOCS * max(1, len(texts))).collect(),
                    key=lambda r: (r["label"], r["doc_id"] is not None, r["doc_id"] or 0, r["text"])):
        texts[r["label"]].append(r["text"])
    return CrossParser(texts)


def predict_language(text: Column, parser: CrossParser) -> Column:
    """Struct of predicted language and score for a text column (no shuffle)."""

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready = parser.ready()
        for batch in batches:
            texts = batch.fillna("").tolist()
            langs: list[str] = []
            scores: list[float] = []
            for a, b in blocks(texts):
                got = ready.predict(texts[a:b])
                langs += got[0]
                scores += got[1]
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict(text)


def identify(docs: DataFrame, parser: CrossParser | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    parser = parser or train(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.withColumn("found", predict_language(F.col("text"), parser)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")
