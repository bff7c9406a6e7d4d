"""Registered queries of the operators, with their production parameters.

Each takes (spark, sf_dir) and applies its operator to the whole table.  The
vocabulary files are found by ``public_tokenizers.path``; other places can be
given to the operators themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketspark.llm import exact_dedup, source_divergence
from marketspark.llm.common import read_table, scratch_path


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.substring_dedup import shortened

    return shortened(read_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.token_files import read_digests, write_files

    path = scratch_path(spark, "token-files")
    write_files(read_table(spark, sf_dir, "documents"), path, _vocabulary("word_bpe_49k.json"))
    return read_digests(spark, path)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.pii import personal_data

    return personal_data(read_table(spark, sf_dir, "documents"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.secret_ledger import secrets

    return secrets(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.decontaminate import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.sharding import shard

    return shard(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.language_id import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.piece_codec import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.source_divergence import audit

    return audit(read_table(spark, sf_dir, "documents"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.vector_dedup import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketspark.llm.spelling_variants import variants

    return variants(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_token_files": op2_token_files,
        "op3_minhash": op3_minhash,
        "op4_pii": op4_pii,
        "op5_secret_ledger": op5_secret_ledger,
        "op6_decontamination": op6_decontamination,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_sharding": op8_sharding,
        "op9_language_id": op9_language_id,
        "op10_piece_codec": op10_piece_codec,
        "op11_source_divergence": op11_source_divergence,
        "op12_vector_dedup": op12_vector_dedup,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": pipeline,
    }


def llm_oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op7_exact_dedup": exact_dedup.ORACLE, "op11_source_divergence": source_divergence.ORACLE}
