"""Operator 10: SentencePiece (merge type) encoding and decoding.

A text becomes a symbol sequence (one symbol per character, space as U+2581,
one such mark put in front).  An agenda holds every adjacent symbol pair whose
concatenation is in the vocabulary, ordered by vocabulary score, then position;
the best pair is merged, stale entries are skipped, and the pairs formed with
the new neighbours enter the agenda.  Characters left outside the vocabulary
fall back to their UTF-8 bytes.

No vocabulary entry holds a mark after another character (checked when the
model is loaded), so no merge crosses from a character to a following mark:
the text is cut there into units, each distinct unit goes through the agenda
once per worker (bounded memory) and is checked there against the
sentencepiece library, batch by batch; a difference raises an error.

Defined cases: NULL and empty texts give no ids and an empty decoded text; a
NULL doc_id is kept; repeated rows give repeated results; an empty table gives
an empty result.  Texts of any length work: a unit without spaces costs
O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import blocks, id_and_text, side_file

MARK = "▁"
#: Units of more symbols than this use a heap.
SHORT = 32
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    """Encoder and decoder over one model, with a bounded memory of units."""

    def __init__(self, model: bytes, max_units: int = 800_000, max_unit_chars: int = 64, check: bool = True):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        normal = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.cost = {self.pieces[i]: -sp.get_score(i) for i in normal}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if sp.is_byte(i)}
        self.raw = [b"" if sp.is_control(i) else bytes([self.byte_of[i]]) if i in self.byte_of
                    else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(self.pieces)]
        if len(self.byte_of) != 256:
            raise ValueError("the vocabulary needs byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary merges across a space mark; units cannot be cut there")
        if sp.encode(" a  b") != sp.encode(" a") + sp.encode(" b"):
            raise ValueError("the model rewrites spaces; only identity normalisation is supported")
        #: Ids of a unit, as text, and the decoded form of units that do not decode to themselves.
        self.memory: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.max_units, self.max_unit_chars, self.check = max_units, max_unit_chars, check

    # ------------------------------------------------------------ one unit
    def merge(self, unit: str) -> list[int]:
        """Ids of one unit by the score-ordered agenda."""
        out: list[int] = []
        for s in self._short(unit) if len(unit) <= SHORT else self._long(unit):
            if s in self.ids:
                out.append(self.ids[s])
            else:
                out.extend(self.byte_ids[b] for b in s.encode("utf-8"))
        return out

    def _short(self, unit: str) -> list[str]:
        """Few symbols: the agenda is a list by position, its least cost (the leftmost on ties) comes next."""
        get, none = self.cost.get, float("inf")
        symbol = list(unit)
        agenda = [get(unit[i:i + 2], none) for i in range(len(unit) - 1)]
        while agenda:
            least = min(agenda)
            if least == none:
                break
            i = agenda.index(least)
            symbol[i] += symbol.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbol[i] + symbol[i + 1], none)
            if i:
                agenda[i - 1] = get(symbol[i - 1] + symbol[i], none)
        return symbol

    def _long(self, unit: str) -> list[str]:
        """Many symbols: the agenda is a heap; entries of symbols merged meanwhile are skipped."""
        cost = self.cost
        symbol: list[str | None] = list(unit)
        n = len(symbol)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = unit[i:i + 2]
            if pair in cost:
                agenda.append((cost[pair], i, pair))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, pair = pop(agenda)
            s = symbol[i]
            j = right[i]
            if s is None or j >= n or len(s) + len(symbol[j]) != len(pair) or s + symbol[j] != pair:
                continue  # one of the two symbols was merged meanwhile
            symbol[i], symbol[j] = pair, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                joined = pair + symbol[k]
                if joined in cost:
                    push(agenda, (cost[joined], i, joined))
            h = left[i]
            if h >= 0:
                joined = symbol[h] + pair
                if joined in cost:
                    push(agenda, (cost[joined], h, joined))
        return [s for s in symbol if s is not None]

    def unmerge(self, ids: list[int]) -> str:
        """Text of one unit's ids, its space marks as spaces; no leading mark is removed."""
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", errors="replace")

    # --------------------------------------------------------- whole texts
    def units(self, text: str) -> list[str]:
        return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []

    def _learn(self, fresh: list[str]) -> dict[str, str]:
        """Agenda results of units not in memory, held against the library."""
        ids = [self.merge(u) for u in fresh]
        plain = [u.replace(MARK, " ") for u in fresh]
        if self.check:
            for u, own, theirs in zip(fresh, ids, self.library.encode([p[1:] for p in plain], num_threads=1), strict=True):
                if own != theirs and len(u) > 1:
                    raise AssertionError(f"agenda and library differ on {u!r}: {own} {theirs}")
        for u, p, i in zip(fresh, plain, ids, strict=True):
            if (decoded := self.unmerge(i)) != p:
                self.odd[u] = decoded
        return {u: ",".join(map(str, i)) for u, i in zip(fresh, ids, strict=True)}

    def batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids as decimals joined by commas, and its decoded form.

        New units are learnt for about a million characters at a time.
        """
        for a, b in blocks(texts):
            cut = [self.units(t) for t in texts[a:b]]
            if len(self.memory) > self.max_units:
                self.memory.clear()
                self.odd.clear()
            memory = self.memory
            fresh = set().union(*cut).difference(memory)
            memory.update(self._learn(list(fresh)))
            odd = self.odd
            for units in cut:
                plain = "".join([odd.get(u, u) for u in units]) if odd else "".join(units)
                yield ",".join([memory[u] for u in units]), plain.replace(MARK, " ")[1:]  # the mark in front goes again
            for u in fresh:
                if len(u) > self.max_unit_chars:
                    del memory[u]

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.merge(u)]

    def decode(self, ids: list[int]) -> str:
        text = self.unmerge(ids)
        return text[1:] if text.startswith(" ") and ids and self.pieces[ids[0]].startswith(MARK) else text


_CODECS: dict[bytes, PieceCodec] = {}


def worker_codec(model: bytes) -> PieceCodec:
    """One codec per Python worker and model, so its memory of units lasts over tasks."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def piece_digest(text: Column, model_path: str) -> Column:
    """Struct of token count and digests of ids and decoded text (Arrow batches, no shuffle)."""
    model = side_file(model_path)

    @F.pandas_udf(RESULT)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = worker_codec(model)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for ids, plain in codec.batch(batch.fillna("").tolist()):
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode("ascii")).hexdigest())
                decoded_sha.append(hashlib.sha256(plain.encode("utf-8")).hexdigest())
            yield pd.DataFrame({"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha})

    return digest(text)


def piece_ids(text: Column, model_path: str) -> Column:
    """Array of token ids of each text."""
    model = side_file(model_path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = worker_codec(model)
        for batch in batches:
            yield pd.Series([[int(x) for x in ids.split(",")] if ids else []
                             for ids, _ in codec.batch(batch.fillna("").tolist())])

    return encode(text)


def piece_text(ids: Column, model_path: str) -> Column:
    """Text of each id array (NULL for a NULL array)."""
    model = side_file(model_path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = worker_codec(model)
        for batch in batches:
            yield pd.Series([None if x is None else codec.decode([int(i) for i in x]) for x in batch], dtype=object)

    return decode(ids)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    d = id_and_text(docs).withColumn("codec", piece_digest(F.col("text"), model_path))
    return d.select("doc_id", "codec.n_tokens", "codec.ids_sha256", "codec.decoded_sha256")
