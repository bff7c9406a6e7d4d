"""Benchmark: full warehouse rebuild plus every report and data test.

Runs on ``local[$BENCH_CPUS]`` over the driver tables in ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) and prints one JSON line:

    {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Timed steps, in order:

* ``stg_events`` / ``stg_transactions``: dedupe and write of the shared staging tables;
* one entry per mart: build and write (marts on marts read the written tables);
* one entry per report / data test: executed over the written marts with the
  ``noop`` sink (the full result is computed, nothing is collected).

* ``calibration:`` entries first: fixed work outside the total, to tell a slower host from a slower plan;
* one entry per intermediate model, and ``query:`` entries for some registered
  queries run from the raw tables, planning included.

Warehouse files go to a fresh scratch folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from marketspark.plans.warehouse import INTERMEDIATE, MARTS, STATES, downstream_models, staging_models  # noqa: E402
from marketspark.plans.registry import QUALITY, REPORTS, all_queries  # noqa: E402
from marketspark.session import get_or_create_session  # noqa: E402
from marketspark.sources import materialise, raw_from_driver  # noqa: E402
from marketspark.sources.fixtures import TRANSACTION_TIE_BREAK  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    memory = os.environ.get("BENCH_DRIVER_MEMORY", "16g")
    spark = get_or_create_session(
        f"local[{cpus}]", app_name="marketspark-bench", shuffle_partitions=cpus,
        extra_conf={"spark.driver.memory": memory},
    )
    root = tempfile.mkdtemp(prefix="bench-warehouse-")  # one machine, one process
    timings: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        timings[name] = round(time.perf_counter() - t, 3)
        return out

    # The same work in every round, so that a slower host shows: interpreter speed, then one shuffle of generated rows.
    timed("calibration:python", lambda: sum(i * i for i in range(5_000_000)))
    timed("calibration:spark", lambda: spark.range(8_000_000).selectExpr("id % 1000003 AS k", "id * 7 AS v").groupBy("k").sum("v")
          .write.format("noop").mode("overwrite").save())
    t_all = time.perf_counter()
    raw = raw_from_driver(spark, sf_dir)
    stg = staging_models(raw, {"transactions": TRANSACTION_TIE_BREAK})
    for name in ("stg_events", "stg_transactions"):
        stg[name] = timed(name, lambda n=name: materialise(spark, stg[n], os.path.join(root, "staging"), n))

    def write_mart(name, df):
        return timed(name, lambda: materialise(spark, df, os.path.join(root, "marts"), name))

    models = downstream_models(stg, on_mart=write_mart)
    for name in (*MARTS, *STATES):  # written in dependency order, each timed by write_mart
        models[name]
    timings["rebuild_total"] = round(time.perf_counter() - t_all, 3)

    for name, fn in {**REPORTS, **QUALITY}.items():
        timed(name, lambda f=fn: f(models).write.format("noop").mode("overwrite").save())
    for name in INTERMEDIATE:
        timed(name, lambda n=name: models[n].write.format("noop").mode("overwrite").save())
    # The same queries as registered: planned and run from the raw tables.
    for name in ("cohort_matrix", "dq_report", "campaign_kpis", "int_cart_activity"):
        timed(f"query:{name}", lambda n=name: all_queries()[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(time.perf_counter() - t_all, 3)

    sf_match = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "sf": float(sf_match.group(1)) if sf_match else sf_dir,
        "cpus": cpus,
        "driver_memory": memory,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
