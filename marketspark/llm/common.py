"""Helpers shared by the operators: scratch tables, input projection, resource loading.

Intermediate tables go to the shared folder that the session names in
``spark.checkpoint.dir``.  Each call gets a folder of its own, so a repeated
or concurrent run never reads another run's files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side file (vocabulary, model) that is sent to every task, in bytes.
MAX_SIDE_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Only a single-process session (``local`` / ``local[n]``, as in tests) may
    leave it unset; it then gets a temporary folder.  On a cluster an unset
    folder is an error, as no machine-local path is visible to all executors.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)
        return folder
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    schema = df.schema
    for field in schema:
        field.nullable = True
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long) and ``text`` (string) only, so other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def side_file(path: str) -> bytes:
    """A vocabulary or model file, read on the driver under the size bound."""
    with open(path, "rb") as f:
        data = f.read(MAX_SIDE_BYTES + 1)
    if len(data) > MAX_SIDE_BYTES:
        raise ValueError(f"{path} exceeds {MAX_SIDE_BYTES} bytes")
    return data


def blocks(texts, max_chars: int = 1 << 20):
    """Consecutive slices ``(start, stop)`` of a list of texts, each of about ``max_chars``.

    A single longer text is a slice of its own.
    """
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and size + n > max_chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
