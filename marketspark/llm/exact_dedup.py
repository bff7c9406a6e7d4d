"""Operator 7: exact dedup by a tree merge of sorted digest runs (built-in functions only).

Each input partition becomes a run: its digests in order, one entry per digest
with the best row and the row count.  Runs are then merged in binomial rounds:
in a round, run ``i`` goes to run ``i`` with its lowest ``ROUND_BITS`` set bits
positions cleared, so ``2 ** ROUND_BITS`` runs meet; equal digests merge, and
the best row (longest original, then smallest doc_id) stays at every level.
An entry is one row per digest however many copies a run held, so a text that
fills a third of the table contributes one row per run, and ``log(runs)``
rounds of narrow rows are all that is shuffled; texts never are.

Digests are verified by a second, independent hash and the length: entries
merge only if SHA-256, xxHash64 and byte length of the normalised text agree.

Normalised text: every character of ``[\\x20\\x09-\\x0D]`` deleted.

Defined cases: NULL text counts as empty, empty texts are equal to each other;
a NULL doc_id is larger than any other; of rows that repeat doc_id and text one
stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import id_and_text, written

SPACE = " \t\n\x0b\x0c\r"
ROUND_BITS = 3
KEY = ["sha", "check", "bytes"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def with_digests(docs: DataFrame) -> DataFrame:
    """Adds sha, check, bytes (of the normalised text) and chars (of the original)."""
    plain = normalised(F.col("text"))
    return docs.select("*", F.sha2(plain, 256).alias("sha"), F.xxhash64(plain).alias("check"),
                       F.octet_length(plain).alias("bytes"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))


def _merge(runs: DataFrame) -> DataFrame:
    """One entry per run and digest: best row and row count (sort-based, partial before the shuffle)."""
    return runs.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def keepers(rows: DataFrame) -> DataFrame:
    """One row per digest: key columns, keep_id, keep_row, group_size.

    ``rows`` is a written table with run, row, doc_id, chars and the key columns.
    """
    best = F.struct((-F.col("chars")).alias("order"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    runs = _merge(rows.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("n")))
    last = rows.agg(F.max("run")).first()[0] or 0
    while last > 0:
        runs = _merge(runs.withColumn("run", F.shiftright("run", ROUND_BITS)))
        last >>= ROUND_BITS
    return runs.select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"),
                       F.col("n").alias("group_size"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    d = with_digests(id_and_text(docs)).select(
        "doc_id", *KEY, "chars", F.monotonically_increasing_id().alias("row"))
    # The partition part of the row number is the run; written, so it is the same in every later read.
    rows = written(d.withColumn("run", F.shiftright("row", 33)), "exact-rows")
    # Both join sides are plain reads, so a digest of very many rows is split by the skew join.
    best = written(keepers(rows), "exact-keepers")
    return rows.join(best, KEY).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                                       F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of ``docs``.

    Texts move once, by (doc_id, digest), which no group of copies shares; rows
    that repeat both are reduced to the longest in the same partitioning.
    """
    names = docs.columns
    all_rows = docs.select(F.struct(*names).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = with_digests(all_rows)
    narrow = with_digests(id_and_text(docs)).select(
        "doc_id", *KEY, "chars", F.monotonically_increasing_id().alias("row"))
    rows = written(narrow.withColumn("run", F.shiftright("row", 33)), "exact-rows")
    best = keepers(rows).select(F.coalesce("keep_id", F.lit(-1)).alias("key_id"), F.col("keep_id").isNull().alias("no_id"),
                                F.col("sha").alias("key_sha"))
    d = d.withColumns({"key_id": F.coalesce("doc_id", F.lit(-1)), "no_id": F.col("doc_id").isNull(), "key_sha": F.col("sha")})
    first = Window.partitionBy("key_id", "no_id", "key_sha").orderBy(F.desc("chars"), "text")
    return d.join(best, ["key_id", "no_id", "key_sha"], "left_semi") \
        .withColumn("copy", F.row_number().over(first)).where("copy = 1").select("doc.*").select(*names)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY plain ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY plain) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY plain ORDER BY length(t) DESC, doc_id) AS kept,
       sha256(plain) AS text_sha256
FROM d
"""
