"""Operator 2: token-id files with a shared zstandard dictionary.

A folder of token files holds two Parquet tables:

* ``dictionary``: ``dict_hash`` (SHA-256, hex) and ``content``, a zstandard
  dictionary trained on the serialized id arrays of a bounded sample;
* ``blocks``: rows in ascending doc_id order.  A block row holds the frames of
  consecutive documents (each compressed on its own with the dictionary), the
  dictionary's hash, the number of ids in its part before it, and an offset
  index (doc_id, byte offset, byte length, number of ids), so one short
  document is read by decompressing its frame alone.

Serialized ids are little-endian unsigned integers, two bytes wide where the
vocabulary has at most 65,536 ids, else four.  Documents are range-partitioned
by doc_id and the text's beginning, and sorted within the part; part numbers ascend with doc_id, so the
position of a document in the whole id stream is (ids of earlier parts) + (ids
of earlier blocks of its part) + (ids before it in its block).  Only the number
of ids per part crosses between tasks.

Texts are split where no token of the vocabulary can span: at white space, and
behind a letter before another Latin-1 (beside wider characters: ASCII)
character that is no letter.  The pieces of about a million characters together
are cut by NumPy and made distinct by Arrow; each distinct piece is looked up in
a bounded memory of the worker, which the library fills, words of letters many
at a time.

Defined cases: NULL text counts as empty; an empty document holds the end id
only; a NULL doc_id sorts first; rows that repeat a doc_id are all kept,
ordered by text; an empty table gives an empty file.
"""

from __future__ import annotations

import hashlib
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.llm.common import blocks, id_and_text, side_file

END_ID = 1
LEVEL = 3
#: Documents in the training sample, and the longest text taken into it.  The
#: sample is the documents of smallest hash, so it does not depend on partitioning.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 16_384, 32 << 10
#: Frames of a block together, in bytes (a larger single frame is a block of its own).
BLOCK_BYTES = 1 << 20
#: Characters of a text that take part in the range bounds.
RANGE_CHARS = 64

#: Words of letters that the library encodes as one text.
JOINED_WORDS = 128

_SPACE, _LETTER, _OTHER, _JOINED = range(4)


def _kinds(letters: str, rest: int, beyond: int) -> bytes:
    """Kind of each byte: white space, letter, cut off from a letter before it, or joined to what is before it."""
    kinds = bytearray([rest] * 128 + [beyond] * 128)
    for kind, some in ((_SPACE, " \t\n\v\f\r"), (_LETTER, letters)):
        for c in some:
            kinds[ord(c)] = kind
    return bytes(kinds)


_LATIN_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
#: No token of the vocabulary's splitting rule goes from a letter on to another character.  Beside wider characters
#: (marks that join a letter) only ASCII is cut; texts with special tokens only at white space.
_LATIN = _kinds(_LATIN_LETTERS, _OTHER, _OTHER)
_WIDE = _kinds(_LATIN_LETTERS[:52], _OTHER, _JOINED)
_MARKED = _kinds("", _JOINED, _JOINED)
#: Latin-1 letters in lower case.
_LOWER = bytes(map(ord, "".join(map(chr, range(256))).lower()))
_INDEX = "array<struct<doc_id: long, offset: long, length: long, n_tokens: long>>"
BLOCK_SCHEMA = ("part int, block int, first_doc long, last_doc long, n_docs long, n_tokens long, "
                f"part_start long, width int, dict_hash string, frames binary, index {_INDEX}")


def folded(text: str) -> tuple[bytes, str, bytes]:
    """The text's bytes, in lower case where that changes no ids, their encoding, and the kinds to cut them by."""
    if "<|" in text:  # special tokens are found before letters are folded
        return text.encode("utf-8"), "utf-8", _MARKED
    try:
        return text.encode("latin-1").translate(_LOWER), "latin-1", _LATIN
    except UnicodeEncodeError:
        return text.encode("utf-8"), "utf-8", _WIDE


def cut(data: bytes, kinds: bytes) -> tuple[np.ndarray, pa.Array]:
    """Where each piece starts, and the pieces, which the library encodes independently of each other."""
    kind = np.frombuffer(b" ".translate(kinds) + data.translate(kinds) + b" ".translate(kinds), np.uint8)
    before, kind, after = kind[:-2], kind[1:-1], kind[2:]
    inside = kind != _SPACE
    starts = np.flatnonzero(inside & ((before == _SPACE) | ((before == _LETTER) & (kind == _OTHER))))
    ends = np.flatnonzero(inside & ((after == _SPACE) | ((kind == _LETTER) & (after == _OTHER)))) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    pieces = np.frombuffer(data, np.uint8)[inside]
    return starts, pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(pieces)])


class WordEncoder:
    """Whole-text ids through the tokenizers library, one look-up per distinct piece."""

    def __init__(self, vocabulary: bytes, max_pieces: int = 600_000, max_piece_chars: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.decode("utf-8"))
        self.size = self.library.get_vocab_size()
        # Two generations of at most max_pieces each: pieces still in use pass from the older one to the newer.
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.max_pieces, self.max_piece_chars = max_pieces, max_piece_chars
        known = self.library.get_vocab()
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        #: By id: the token ends a word.
        self.ends_word = np.zeros(max(known.values(), default=0) + 1, bool)
        if suffix:
            self.ends_word[[i for token, i in known.items() if token.endswith(suffix)]] = True

    def encode(self, fresh: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with its ids from the library, in any order."""
        words, single = [p for p in fresh if p.isalpha()], [p for p in fresh if not p.isalpha()]
        for i in range(0, len(words), JOINED_WORDS):
            some = words[i:i + JOINED_WORDS]
            ids = _little_endian(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids)
            ends = (4 * np.flatnonzero(self.ends_word[np.frombuffer(ids, "<u4")]) + 4).tolist()
            if len(ends) == len(some) and ends[-1] == len(ids):
                yield from zip(some, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True)
            else:  # to the library, a piece is not one word
                single += some
        for i in range(0, len(single), JOINED_WORDS):
            some = single[i:i + JOINED_WORDS]
            for p, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                yield p, _little_endian(e.ids)

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of these distinct pieces; new ones are learnt."""
        if len(self.memory) > self.max_pieces:
            self.older, self.memory = self.memory, {}
        found = list(map(self.memory.get, pieces))
        new = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if not new:
            return found
        learnt = {p: self.older[p] for p in new if p in self.older}
        learnt.update(self.encode([p for p in new if p not in learnt]))
        self.memory.update([(p, ids) for p, ids in learnt.items() if len(p) <= self.max_piece_chars])
        return [learnt[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def _of_kind(self, texts: list[bytes], encoding: str, kinds: bytes) -> Iterator[bytes]:
        starts, pieces = cut(b" ".join(texts), kinds)
        distinct = pieces.dictionary_encode()
        known = self.look_up([p.decode(encoding) for p in distinct.dictionary.to_pylist()])
        ids = pa.array(known, pa.large_binary()).take(distinct.indices)
        # Where each text's ids end: behind those of the pieces that start before the next text.
        after = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())]).astype(np.int64)[after].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for a, b in zip([0, *ends], ends, strict=False):
            yield data[a:b].tobytes()

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each whole text as little-endian 32-bit integers.

        Pieces are cut and looked up for about a million characters at a time.
        """
        for a, b in blocks(texts):
            groups: dict[tuple[str, bytes], list[bytes]] = {}
            order = []
            for t in texts[a:b]:
                data, *how = folded(t)
                groups.setdefault(tuple(how), []).append(data)
                order.append(tuple(how))
            done = {how: self._of_kind(some, *how) for how, some in groups.items()}
            for how in order:
                yield next(done[how])


def _little_endian(ids: list[int]) -> bytes:
    """As little-endian unsigned 32-bit integers."""
    if sys.byteorder == "little" and _WORD.itemsize == 4:
        return array("I", ids).tobytes()
    return np.array(ids, dtype="<u4").tobytes()


_WORD = array("I")


_ENCODERS: dict[bytes, WordEncoder] = {}


def worker_encoder(vocabulary: bytes) -> WordEncoder:
    key = hashlib.sha256(vocabulary).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(vocabulary)
    return _ENCODERS[key]


def serialize(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def deserialize(data: bytes, width: int) -> bytes:
    """Back to little-endian 32-bit integers."""
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def sample_texts(docs: DataFrame) -> list[str]:
    """At most SAMPLE_DOCS texts for training: those of smallest hash."""
    fit = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                     & F.length("text").between(1, SAMPLE_CHARS))
    key = F.xxhash64("doc_id", F.lit("token-dictionary"))
    ids = [r[0] for r in fit.select("doc_id").orderBy(key, "doc_id").limit(SAMPLE_DOCS).collect()]
    if not ids:
        return []
    chosen = fit.where(F.col("doc_id").isin(ids)).orderBy("doc_id", "text").limit(SAMPLE_DOCS).collect()
    return [r["text"] for r in chosen]


def train_dictionary(texts: list[str], vocabulary: bytes) -> bytes:
    """Dictionary over serialized id arrays; too small a sample is used as raw content."""
    encoder = WordEncoder(vocabulary)
    width = 2 if encoder.size <= 1 << 16 else 4
    end = END_ID.to_bytes(4, "little")
    samples = [serialize(ids + end, width) for ids in encoder.batch(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b"".join(samples)[-DICTIONARY_BYTES:]
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=True, write_dict_id=False)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID) -> None:
    """Encode every whole text and write the two tables under ``path``."""
    spark = docs.sparkSession
    docs = id_and_text(docs)
    vocabulary = side_file(vocabulary_path)
    dictionary = train_dictionary(sample_texts(docs), vocabulary)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, content binary") \
        .coalesce(1).write.parquet(f"{path}/dictionary")
    end = end_id.to_bytes(4, "little")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(vocabulary)
        width = 2 if encoder.size <= 1 << 16 else 4
        compressor = _compressor(dictionary)
        part = TaskContext.get().partitionId()
        number = part_start = size = tokens = 0
        frames: list[bytes] = []
        index: list[dict] = []

        def block() -> pd.DataFrame:
            known = [x["doc_id"] for x in index if x["doc_id"] is not None]
            return pd.DataFrame([(part, number, min(known, default=None), max(known, default=None), len(index), tokens,
                                  part_start, width, dict_hash, b"".join(frames), list(index))],
                                columns=[c.split(" ")[0] for c in BLOCK_SCHEMA.split(", index")[0].split(", ")] + ["index"])

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].tolist(), encoder.batch(batch["text"].fillna("").tolist()), strict=True):
                ids += end
                frame = compressor.compress(serialize(ids, width))
                if frames and size + len(frame) > BLOCK_BYTES:
                    yield block()
                    number, part_start = number + 1, part_start + tokens
                    size, tokens, frames, index = 0, 0, [], []
                index.append({"doc_id": None if pd.isna(doc_id) else int(doc_id), "offset": size, "length": len(frame),
                              "n_tokens": len(ids) // 4})
                frames.append(frame)
                size, tokens = size + len(frame), tokens + len(ids) // 4
        if frames:
            yield block()

    # A text's beginning splits a doc_id that very many rows repeat, and keeps the range bounds short.
    ordered = docs.repartitionByRange(F.col("doc_id"), F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def open_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(row["content"])
    if hashlib.sha256(content).hexdigest() != row["dict_hash"]:
        raise ValueError("the dictionary does not match its hash")
    return row["dict_hash"], content


def _frames(blocks: DataFrame, dict_hash: str, dictionary: bytes, emit, schema: str) -> DataFrame:
    """Rows of ``emit(block row, document index entry, ids before it in the block, 32-bit ids)``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decompressor = _decompressor(dictionary)
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.dict_hash != dict_hash:
                    raise ValueError("a block was written with another dictionary")
                before, data = 0, memoryview(row.frames)
                for x in row.index:
                    raw = decompressor.decompress(data[x["offset"]:x["offset"] + x["length"]])
                    out.append(emit(row, x, before, deserialize(raw, row.width)))
                    before += x["n_tokens"]
            yield pd.DataFrame(out, columns=names)

    return blocks.mapInPandas(read, schema)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    dict_hash, dictionary = open_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    docs = _frames(blocks.select("part", "part_start", "width", "dict_hash", "frames", "index"), dict_hash, dictionary,
                   lambda row, x, before, ids: (row.part, row.part_start + before, x["doc_id"], len(ids) // 4, zlib.crc32(ids)),
                   "part int, in_part long, doc_id long, n_tokens long, ids_crc32 long")
    # One row per written part, so its size is that of the shuffle's partition list.
    starts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("before"))
    return docs.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this doc_id: block pruning by doc_id range, then single frames."""
    _, dictionary = open_dictionary(spark, path)
    decompressor, out = _decompressor(dictionary), []
    hit = spark.read.parquet(f"{path}/blocks").where(f"first_doc <= {int(doc_id)} AND last_doc >= {int(doc_id)}") \
        .orderBy("part", "block").select("width", "index", "frames")
    entry = F.explode("index").alias("x")
    for row in hit.select("width", "frames", entry).where(F.col("x.doc_id") == int(doc_id)).select(
            "width", F.expr("substring(frames, cast(x.offset + 1 as int), cast(x.length as int))").alias("frame")).collect():
        ids = deserialize(decompressor.decompress(bytes(row["frame"])), row["width"])
        out.append(np.frombuffer(ids, "<u4").tolist())
    return out
