"""Materialisation, catalog registration and ad-hoc SQL over the marts.

A table at a path is replaced safely.  Its folder holds two data folders, used
in turn, and ``pointer``, an append-only log of small JSON records.  A write
goes to the data folder that is not current, and only when it is complete a
record naming that folder is appended; Spark commits that one file by a rename.
So a write that fails, at any time, leaves the old table as it was, a reader
never finds half a table, and a model may read the table that it replaces.  A
frame read before a rebuild stays readable until the rebuild after that one.

A record also holds the version of the input that the table was made from, and
figures observed while it was written, so neither needs a scan later.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER, SLOTS, RANGES = "pointer", ("data-a", "data-b"), "ranges"
_RECORD = "seq long, table string, slot string, version string, figures string"


@dataclass(frozen=True)
class TableRecord:
    """The current state of a written table; ``seq`` counts its complete writes."""

    seq: int = 0
    slot: str | None = None
    version: str | None = None
    figures: Mapping = field(default_factory=dict)


def table_records(spark: SparkSession, paths: Sequence[str]) -> dict[str, TableRecord]:
    """The last record of each written table, by the last part of its path; tables never written are left out."""
    logs = [os.path.join(p, POINTER) for p in paths]
    try:
        found = spark.read.schema(_RECORD).json(logs)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        if len(paths) == 1:
            return {}
        return {k: r for p in paths for k, r in table_records(spark, [p]).items()}
    last = found.where("seq IS NOT NULL").groupBy("table").agg(F.max(F.struct("seq", "slot", "version", "figures")).alias("r"))
    return {r.table: TableRecord(r.r.seq, r.r.slot, r.r.version, json.loads(r.r.figures)) for r in last.collect()}


def table_record(spark: SparkSession, path: str) -> TableRecord:
    return table_records(spark, [path]).get(os.path.basename(path.rstrip("/")), TableRecord())


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), version: str | None = None,
                observe: Mapping[str, Column] | None = None, range_by: Sequence[str] = (), files: int | None = None) -> TableRecord:
    """Replace the table at ``path`` by ``df``, which may read it; ``observe`` names aggregates to record on the way.

    With ``range_by`` each file holds a range of these columns, sorted, and the
    least and greatest value of the first of them in each file are kept beside
    the data, so that ``read_range`` opens the files it needs only.  Further
    columns split a value of the first that very many rows share.
    """
    spark, name = df.sparkSession, os.path.basename(path.rstrip("/"))
    before = table_record(spark, path)
    slot = SLOTS[1] if before.slot == SLOTS[0] else SLOTS[0]
    seen = Observation()
    if observe:
        df = df.observe(seen, *[c.alias(k) for k, c in observe.items()])
    if range_by:
        df = (df.repartitionByRange(files, *range_by) if files else df.repartitionByRange(*range_by)).sortWithinPartitions(*range_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(os.path.join(path, slot))
    if range_by:
        by = F.col(range_by[0])
        spark.read.schema(df.schema).parquet(os.path.join(path, slot)).groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(by).alias("low"), F.max(by).alias("high"), F.count_if(by.isNull()).alias("nulls")) \
            .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"{RANGES}-{slot}"))
    figures = seen.get if observe else {}
    after = TableRecord(before.seq + 1, slot, version, figures)
    spark.createDataFrame([(after.seq, name, slot, version, json.dumps(figures, default=str))], _RECORD) \
        .coalesce(1).write.mode("append").json(os.path.join(path, POINTER))
    return after


def current_path(spark: SparkSession, path: str) -> str:
    """The folder of the current data of a table; ``path`` itself for plain Parquet from elsewhere."""
    slot = table_record(spark, path).slot
    return path if slot is None else os.path.join(path, slot)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current_path(spark, path))


def read_range(spark: SparkSession, path: str, column: str, low, high) -> DataFrame:
    """Rows with ``low <= column < high`` of a table written with ``range_by=(column, ...)``; opens the files of that range only."""
    slot = table_record(spark, path).slot
    if slot is None:
        raise ValueError(f"no table at {path}")
    ranges = spark.read.parquet(os.path.join(path, f"{RANGES}-{slot}"))
    hit = [r.file for r in ranges.where((F.col("high") >= F.lit(low)) & (F.col("low") < F.lit(high))).select("file").collect()]
    whole = spark.read.parquet(os.path.join(path, slot))
    if not hit:
        return whole.limit(0)
    return spark.read.schema(whole.schema).parquet(*hit).where((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))


def materialise(spark: SparkSession, df: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = (),
                version: str | None = None, observe: Mapping[str, Column] | None = None,
                range_by: Sequence[str] = (), files: int | None = None) -> DataFrame:
    """Write ``df`` under ``root/name`` and return a scan of the written table.

    Downstream models then start from files in the shared folder instead of
    re-running (or holding in executor memory) the upstream lineage, so a lost
    executor costs a re-read, not a recompute.  A table that already stands
    there complete for the ``version`` given is read, not written again.
    """
    path = os.path.join(root, name)
    record = table_record(spark, path) if version is not None else TableRecord()
    if record.slot is None or record.version != version:
        record = write_table(df, path, partition_by, version, observe, range_by, files)
    data = os.path.join(path, record.slot)
    if partition_by:
        return spark.read.parquet(data)
    # The schema is known: no footer read to infer it again.
    return spark.read.schema(df.schema).parquet(data)


def input_version(spark: SparkSession, paths: Sequence[str]) -> str:
    """A name for the present state of the files under ``paths``: their names, sizes and times, not their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select(
        "length", F.xxhash64("path", "length", "modificationTime").alias("h"))
    one = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
                    F.coalesce(F.bit_xor("h"), F.lit(0)).alias("h")).first()
    return f"{one.n}-{one.bytes}-{one.h & 0xFFFFFFFFFFFFFFFF:016x}"


def save_as_table(spark: SparkSession, df: DataFrame, name: str, partition_by: tuple[str, ...] = (),
                  bucket_by: tuple[int, str] | None = None) -> DataFrame:
    """Materialise ``df`` as a catalog table (Parquet, replaced) and return a scan of it.

    The data is written to a second table first, which takes the name when it
    is complete, so a write that fails leaves the old table.

    ``bucket_by=(n, key)`` buckets and sorts the table on ``key``, so later
    joins and aggregations on that key between tables bucketed the same way
    read co-partitioned data without a shuffle.
    """
    following = f"{name}__next"
    spark.sql(f"DROP TABLE IF EXISTS {following}")
    w = df.write.mode("overwrite").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        n, key = bucket_by
        w = w.bucketBy(n, key).sortBy(key)
    w.saveAsTable(following)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {following} RENAME TO {name}")
    return spark.table(name)


def register_views(frames: dict[str, DataFrame]) -> None:
    """Expose frames to SQL users as temporary views (lazy, like view models)."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Ad-hoc read-only SQL over registered views; the result stays distributed."""
    return spark.sql(sql)
