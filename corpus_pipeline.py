"""The corpus pipeline: five stages over ``documents``, each written and read again.

Language identification (documents of no determined language go), exact dedup,
MinHash near-dedup (the smallest doc_id of each group stays), benchmark
decontamination, and SentencePiece encoding.  Every stage takes
(spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of ``documents``.

Defined cases are those of the operators: NULL text has no determined language
and goes in the first stage; rows that repeat doc_id and text come down to one;
an empty table gives an empty result; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import read_table, written
from marketspark.llm.decontaminate import drop_contaminated
from marketspark.llm.exact_dedup import drop_duplicates
from marketspark.llm.language_id import UNDETERMINED, predict_language, train
from marketspark.llm.near_dedup import drop_near_duplicates
from marketspark.llm.piece_codec import encode_documents

#: Hundredths of similarity from which the near stage links two documents.
NEAR_SHARE = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents without a determined language go."""
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("doc"))
    found = whole.withColumn("found", predict_language(F.col("doc.text").cast("string"), train(docs)))
    return found.where(F.col("found.lang_pred") != UNDETERMINED).select("doc.*").select(*names)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one row of each group of equal texts stays."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near copies stays."""
    return drop_near_duplicates(docs, NEAR_SHARE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ids and decoded text of every document that is left, as digests."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pieces", pieces)]

#: SQL can't express the automata, the codec or the components: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
