"""Loading the raw tables (CSV seeds or Parquet) as conformed DataFrames."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.sources.schemas import RAW_COLUMNS, RAW_TABLES


def _conform_column(name: str, dtype: T.DataType, present: dict[str, T.DataType]) -> Column:
    if name not in present:
        # A missing optional column reads as NULL, like an all-empty CSV column.
        return F.lit(None).cast(dtype).alias(name)
    c = F.col(name)
    src = present[name]
    if src == dtype:
        return c.alias(name)
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)) and isinstance(src, T.StringType):
        return c.try_cast(dtype).alias(name)
    if isinstance(dtype, T.StringType):
        return c.cast("string").alias(name)
    if isinstance(dtype, T.IntegralType) and isinstance(src, T.StringType):
        return _integral(c, dtype).alias(name)
    return c.try_cast(dtype).alias(name)


def _integral(c: Column, dtype: T.DataType) -> Column:
    """Integer from text; integral decimal text (``12.0``) counts, by way of DECIMAL so that large ids stay exact."""
    d = c.try_cast("decimal(38,10)")
    return F.coalesce(c.try_cast(dtype), F.when(d == F.floor(d), F.floor(d).try_cast(dtype)))


def rejected_values(table: str, df: DataFrame) -> DataFrame:
    """(table_name, column_name, rejected): non-empty values of ``df`` that ``conform_raw`` has to read as NULL."""
    present = {f.name: f.dataType for f in df.schema.fields}
    known = [n for n in RAW_COLUMNS[table] if n in present]
    lost = [F.count_if(F.col(n).isNotNull() & (F.trim(F.col(n).cast("string")) != "")
                       & _conform_column(n, RAW_COLUMNS[table][n], present).isNull()).alias(n) for n in known]
    return df.agg(*lost).unpivot([], known, "column_name", "rejected").select(
        F.lit(table).alias("table_name"), "column_name", "rejected")


def conform_raw(table: str, df: DataFrame, keep_extra: bool = True) -> DataFrame:
    """Project ``df`` onto the canonical raw schema of ``table``.

    Known columns are cast leniently; columns the staging layer does not know
    are kept at the end when ``keep_extra`` (they can serve as dedupe
    tie-breaks) and dropped otherwise.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    cols = [_conform_column(n, t, present) for n, t in RAW_COLUMNS[table].items()]
    if keep_extra:
        cols += [F.col(n) for n in present if n not in RAW_COLUMNS[table]]
    return df.select(*cols)


def read_raw(
    spark: SparkSession,
    root: str,
    fmt: str = "csv",
    tables: tuple[str, ...] = RAW_TABLES,
) -> dict[str, DataFrame]:
    """Read ``<root>/<table>.<fmt>`` for each raw table (full replace semantics).

    ``read_rejected`` counts the values that cannot be read as their column's
    type, and ``read_broken`` returns the records that are no rows of the table.

    CSV seeds are read by header name with every column as text (no schema
    inference pass over the files); ``conform_raw`` then casts by name, so
    column order in the file does not matter.  A quoted value may hold line
    breaks, for which a file is read whole by one task: split large seeds into
    several files of a folder.  Parquet keeps its own types.
    """
    return {t: conform_raw(t, _read_file(spark, root, t, fmt)) for t in tables}


def read_rejected(
    spark: SparkSession,
    root: str,
    fmt: str = "csv",
    tables: tuple[str, ...] = RAW_TABLES,
) -> DataFrame:
    """(table_name, column_name, rejected) over all raw tables, one pass per table."""
    return reduce(DataFrame.unionByName, [rejected_values(t, _read_file(spark, root, t, fmt)) for t in tables])


def read_broken(spark: SparkSession, root: str, tables: tuple[str, ...] = RAW_TABLES) -> DataFrame:
    """(table_name, file, record): the text of each CSV record with too few or too many fields or a broken quote."""
    return reduce(DataFrame.unionByName, [
        _csv_records(spark, _file(root, t, "csv"))[0].where(F.col(_BROKEN).isNotNull())
        .select(F.lit(t).alias("table_name"), F.col(_FILE).alias("file"), F.col(_BROKEN).alias("record")) for t in tables])


_BROKEN, _FILE = "__broken", "__file"


def _file(root: str, table: str, fmt: str) -> str:
    return os.path.join(root, f"{table}.{fmt}")


def _csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Records of a CSV table with all fields as text, and the field names; ``_BROKEN`` holds a record that is no row.

    A quote that is never closed takes the lines behind it into its record.
    Such a record (its quotes do not pair up) is read again line by line, so
    the lines behind it are rows as they would be without it.
    """
    options = {"mode": "PERMISSIVE", "escape": '"', "columnNameOfCorruptRecord": _BROKEN}  # a quote is doubled within quotes
    names = spark.read.options(header=True, multiLine=True, escape='"').csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BROKEN]])
    read = spark.read.schema(schema).options(header=True, multiLine=True, **options).csv(path) \
        .select(*[F.col(f"`{n}`") for n in [*names, _BROKEN]], F.col("_metadata.file_path").alias(_FILE))
    text = F.col(_BROKEN)
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"')))
    whole = F.array(F.struct(*[F.col(f"`{n}`") for n in [*names, _BROKEN]]))
    lines = F.filter(F.split(text, "\r?\n"), lambda line: line != "")
    fields = ", ".join(f"`{f.name}` string" for f in schema.fields)
    again = F.transform(lines, lambda line: F.from_csv(line, fields, options))
    records = read.select(_FILE, F.inline(F.when(text.isNotNull() & (quotes % 2 == 1), again).otherwise(whole)))
    return records, names


def _read_file(spark: SparkSession, root: str, table: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        records, names = _csv_records(spark, _file(root, table, fmt))
        return records.where(F.col(_BROKEN).isNull()).select(*[F.col(f"`{n}`") for n in names])
    if fmt == "parquet":
        return spark.read.parquet(_file(root, table, fmt))
    raise ValueError(f"unsupported raw format: {fmt}")
