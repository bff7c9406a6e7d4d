"""Operator 5: secret scan with an incremental blob ledger.

Every historical version of a path is a row; its text is content-addressed by
SHA-256, so equal texts are one blob however many paths and versions hold it.
The ledger is a folder of two append-only tables:

* ``scans``: (blob, rules) — the rule versions a blob has been scanned with;
* ``findings``: (blob, rule, found) — positions found by a rule version.

An increment scans the (blob, rule version) pairs that ``scans`` does not have:
one text per blob is scanned, and only with the rule versions it lacks.  Copies
of a blob are reduced before they are shuffled (partial aggregation by blob).
Findings are joined back to all paths; both sides of that join are plain reads,
so a blob that very many paths share is split by the skew join.

Positions are code points of the whole text, end exclusive.  Matches of a rule
are leftmost and do not overlap; those that fail a rule's test are dropped.

Defined cases: NULL text is the empty blob; a NULL path keeps its row; rows
that repeat get the same findings; an empty table scans nothing; texts of any
length are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import scratch_path, written

# Rule name, version, pattern, least length of the tested group, tested group.
RULES = [
    ("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", 1, r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", 1, r"[0-9a-f]{32,}", 32, 0),
    ("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
    # Begins at the first "eyJ" of its run of characters: a later one can't match where that one does not.
    ("web_token", 1, r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(?P<span>eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+)", 1, 0),
    ("prefixed", 1, r"(?:ghp_|gho_|ghs_|glpat-|xox[abp]-)[A-Za-z0-9-]{16,}", 1, 0),
]
#: Unseen blobs that are found among the texts by a broadcast of their hashes, about 10 MB.
FEW_BLOBS = 100_000
BASE = ["assign", "access", "hex"]
ORDER = {name: i for i, (name, *_) in enumerate(RULES)}
_SPAN = "struct<kind: string, start: long, end: long>"
_SCANNED = "blob string, rules array<string>, found array<struct<rule: string, kind: string, start: long, end: long>>"


def rule_version(rule: tuple) -> str:
    return f"{rule[0]}@{rule[1]}"


def _compiled(rule: tuple) -> re.Pattern:
    # Only the words of "assign" are matched in either case; ASCII keeps other letters from folding into them.
    return re.compile(rule[2], re.ASCII | (re.IGNORECASE if rule[0] == "assign" else 0))


def scan_text(text: str, rules: list[tuple], patterns: list[re.Pattern]) -> list[tuple[str, str, int, int]]:
    """(rule version, kind, start, end) of all matches in a whole text."""
    out = []
    for rule, pattern in zip(rules, patterns, strict=True):
        name, _, _, least, group = rule
        span = "span" if "span" in pattern.groupindex else 0
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((rule_version(rule), name, *m.span(span)))
    return out


class Ledger:
    """A ledger folder in a store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, rules: list[tuple] | None = None):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules or RULES

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scans(self) -> DataFrame:
        return self._table("scans", "blob string, rules array<string>")

    def findings(self) -> DataFrame:
        return self._table("findings", "blob string, rule string, kind string, start long, end long")

    def pending(self, blobs: DataFrame) -> DataFrame:
        """blob, todo: blobs that lack a current rule version, with those they lack.  Only hashes are shuffled."""
        current = F.array(*[F.lit(rule_version(r)) for r in self.rules])
        seen = self.scans().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        left = blobs.select("blob").distinct().join(seen, "blob", "left")
        return left.select("blob", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")) \
            .where("size(todo) > 0")

    def _unseen(self, blobs: DataFrame) -> DataFrame:
        """blob, content, todo of what is to be scanned; seen texts are not shuffled.

        What is to be scanned is found by hashes first.  If that is little, it is
        sent to all tasks (``FEW_BLOBS`` checked rows of a hash); if it is more,
        most texts are unseen, as in a first scan, and move once anyway.
        """
        todo = written(self.pending(blobs), "ledger-pending")
        few = todo.limit(FEW_BLOBS + 1).count() <= FEW_BLOBS
        texts = blobs.join(F.broadcast(todo.select("blob")), "blob", "left_semi") if few else blobs
        return texts.groupBy("blob").agg(F.first("content").alias("content")).join(todo, "blob")

    def add(self, versions: DataFrame, text_col: str = "text") -> DataFrame:
        """Scan what is unseen of ``versions`` and append it; returns what was scanned (blob, rules, found)."""
        content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        blobs = versions.select(F.sha2(content, 256).alias("blob"), content.alias("content"))
        rules = self.rules

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            patterns = {rule_version(r): (r, _compiled(r)) for r in rules}
            for batch in batches:
                found = []
                for text, todo in zip(batch["content"], batch["todo"], strict=True):
                    chosen = [patterns[t] for t in todo]
                    found.append([dict(zip(("rule", "kind", "start", "end"), x, strict=True))
                                  for x in scan_text(text, [r for r, _ in chosen], [p for _, p in chosen])])
                yield pd.DataFrame({"blob": batch["blob"], "rules": batch["todo"], "found": found})

        scanned = written(self._unseen(blobs).mapInPandas(scan, _SCANNED), "ledger-increment")
        scanned.where("size(found) > 0").select("blob", F.explode("found").alias("f")).select("blob", "f.*") \
            .write.mode("append").parquet(f"{self.path}/findings")
        # Scans come last: an increment that breaks off is scanned again, and equal findings are read once.
        scanned.select("blob", "rules").write.mode("append").parquet(f"{self.path}/scans")
        return scanned

    def paths(self, versions: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
        """Every row of ``versions`` with its blob's findings under the current rules, in order of start and kind."""
        current = [rule_version(r) for r in self.rules]
        kind_order = F.create_map(*[x for r in self.rules for x in (F.lit(r[0]), F.lit(ORDER.get(r[0], len(ORDER))))])
        held = self.findings().where(F.col("rule").isin(current)).distinct().groupBy("blob").agg(
            F.sort_array(F.collect_list(F.struct("start", kind_order[F.col("kind")].alias("place"), "end", "kind"))).alias("sorted"))
        held = written(held.select("blob", F.transform("sorted", lambda x: F.struct(
            x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found")), "ledger-findings")
        content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        named = written(versions.select(*columns, F.sha2(content, 256).alias("blob")), "ledger-paths")
        return named.join(held, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(f"array<{_SPAN}>")))


def _joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _count(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def secrets(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    ledger = ledger or Ledger(docs.sparkSession, scratch_path(docs.sparkSession, "blob-ledger"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ledger.add(d)
    found = ledger.paths(d, ["doc_id"])
    base = F.filter("found", lambda x: x["kind"].isin(BASE))
    return found.select(
        "doc_id", *[_count("found", k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
