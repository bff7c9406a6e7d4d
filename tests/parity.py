"""Spark query vs DuckDB oracle comparison (order-insensitive).

Usable from pytest and as a script::

    python tests/parity.py /root/testdata/sf0.01 [key ...] [--json out.json]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if str(type(v)).endswith("Timestamp'>"):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    return v


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT",
}


def type_mismatches(spark_df, rel) -> list[tuple[str, str, str]]:
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for name, st in spark_df.dtypes:
        if name in duck and SPARK_TO_DUCK.get(st, st.upper()) != duck[name]:
            out.append((name, st, duck[name]))
    return out


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=lambda t: repr(t))


def compare(spark_df, con, sql: str) -> dict:
    """Return a dict with ok flag and details."""
    spark_cols = spark_df.columns
    srows = [r.asDict(recursive=True) for r in spark_df.collect()]
    rel = con.sql(sql)
    dcols = rel.columns
    drows = [dict(zip(dcols, t)) for t in rel.fetchall()]
    out = {"spark_rows": len(srows), "oracle_rows": len(drows)}
    if sorted(spark_cols) != sorted(dcols):
        out.update(ok=False, reason=f"columns differ: spark-only {sorted(set(spark_cols) - set(dcols))}, "
                                    f"oracle-only {sorted(set(dcols) - set(spark_cols))}")
        return out
    cols = sorted(spark_cols)
    types = type_mismatches(spark_df, rel)
    if types:
        out.update(ok=False, reason=f"types differ (column, spark, duckdb): {types}")
        return out
    a, b = _rows(srows, cols), _rows(drows, cols)
    if len(a) != len(b):
        out.update(ok=False, reason="row count differs")
        return out
    mismatches = [(x, y) for x, y in zip(a, b) if x != y]
    if mismatches:
        out.update(ok=False, reason=f"{len(mismatches)} rows differ", cols=cols, example=mismatches[:2])
        return out
    out["ok"] = True
    return out


def main(argv: list[str]) -> int:
    json_out = None
    if "--json" in argv:
        i = argv.index("--json")
        json_out = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    summary = {}
    import __spark_entry__ as entry
    from marketspark.session import get_or_create_session

    spark = get_or_create_session("local[8]", shuffle_partitions=8)
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = duck_connection(sf_dir)
    bad = 0
    for k in keys or list(queries):
        t = time.time()
        try:
            res = compare(queries[k](spark, sf_dir), con, oracle[k]) if k in oracle else {"ok": None}
        except Exception as e:  # noqa: BLE001
            res = {"ok": False, "reason": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += res.get("ok") is False
        summary[k] = {"ok": res.get("ok"), "rows": res.get("spark_rows"), "sec": round(time.time() - t, 2),
                      "reason": res.get("reason", "")}
        print(f"{k:32s} {res.get('ok')!s:5s} {time.time() - t:6.2f}s "
              f"{res.get('spark_rows', '')}/{res.get('oracle_rows', '')} {res.get('reason', '')} "
              f"{res.get('example', '')}", flush=True)
    print(f"FAILED: {bad}")
    if json_out:
        import json

        with open(json_out, "w") as f:
            json.dump({"sf_dir": sf_dir, "failed": bad, "queries": summary}, f, indent=1)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
