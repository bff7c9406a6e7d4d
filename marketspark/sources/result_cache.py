"""Results of reports kept by plan and input, in the shared folder.

An entry belongs to the text of the analysed plan (expression numbers put in
order of appearance), the plan's semantic hash and the state of every input
file (name, size, time).  A changed file gives another key, so a result is
never read for an input that it was not made from.  Plans that read no file, or
call a non-deterministic function, are not kept.

The folder holds at most ``max_bytes`` of results: the entries used longest ago
are emptied first, and a result above the bound is not kept.  What is held is
told by an append-only log, so a cache serves later sessions too.  A frame whose
entry is emptied before it is used fails when it is read.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.sources.sinks import input_version

_LOG = "seq long, key string, bytes long"
_UNSTABLE = re.compile(r"\b(rand|randn|uuid|shuffle|monotonically_increasing_id|current_timestamp|current_date|now|input_file_name)\(", re.I)


def plan_text(df: DataFrame) -> str:
    """The analysed plan as text, the same for the same query however often it is built."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    analysed = out.getvalue().split("== Analyzed Logical Plan ==")[1].split("== Optimized Logical Plan ==")[0]
    order: dict[str, str] = {}
    return re.sub(r"#\d+", lambda m: order.setdefault(m[0], f"#{len(order)}"), analysed)


class ResultCache:
    def __init__(self, spark: SparkSession, path: str, max_bytes: int = 1 << 30):
        self.spark, self.path, self.max_bytes = spark, path.rstrip("/"), max_bytes

    def key(self, df: DataFrame) -> str | None:
        """Name of the result of ``df`` over its present input; None if it is not to be kept."""
        files, text = df.inputFiles(), plan_text(df)
        if not files or _UNSTABLE.search(text):
            return None
        parts = [text, str(df.semanticHash()), df.schema.json(), *sorted(files), input_version(self.spark, files)]
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()

    def _held(self) -> dict[str, tuple[int, int]]:
        """key: (last use, bytes) of what is held."""
        try:
            log = self.spark.read.schema(_LOG).json(f"{self.path}/log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        last = log.where("seq IS NOT NULL").groupBy("key").agg(F.max(F.struct("seq", "bytes")).alias("r"))
        return {r.key: (r.r.seq, r.r.bytes) for r in last.collect() if r.r.bytes}

    def _note(self, entries: list[tuple[int, str, int]]) -> None:
        self.spark.createDataFrame(entries, _LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def _folder(self, key: str) -> str:
        return os.path.join(self.path, f"result-{key}")

    def get(self, df: DataFrame) -> DataFrame:
        """``df`` from the cache; a result that is not held is computed once, written and read back."""
        key = self.key(df)
        if key is None:
            return df
        held = self._held()
        seq = max((s for s, _ in held.values()), default=0) + 1
        read = self.spark.read.schema(df.schema)
        if key in held:
            self._note([(seq, key, held[key][1])])
            return read.parquet(self._folder(key))
        df.write.mode("overwrite").parquet(self._folder(key))
        size = int(input_version(self.spark, [self._folder(key)]).split("-")[1])
        if size > self.max_bytes:
            self._empty(key)
            return df
        out, total = [], size + sum(b for _, b in held.values())
        for old, (_, b) in sorted(held.items(), key=lambda x: x[1]):
            if total <= self.max_bytes:
                break
            out.append(old)
            total -= b
        self._note([(seq, key, size), *((seq, old, 0) for old in out)])
        for old in out:  # noted first
            self._empty(old)
        return read.parquet(self._folder(key))

    def _empty(self, key: str) -> None:
        """A line of text instead of the result: who still reads it gets an error, not an empty result."""
        self.spark.createDataFrame([("emptied",)], "x string").coalesce(1).write.mode("overwrite").text(self._folder(key))
