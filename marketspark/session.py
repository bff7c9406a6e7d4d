"""Session helpers.

The library never creates a session behind the caller's back; these helpers
are for scripts, tests and the bench.  On a cluster the session (and its
``spark.checkpoint.dir``) comes from the deployment.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the warehouse relies on regardless of where it runs.
WAREHOUSE_CONF = {
    # All timestamps are zone-free (TIMESTAMP_NTZ); pin the zone anyway so
    # date/time casts of zoned input cannot shift between drivers.
    "spark.sql.session.timeZone": "UTC",
    # AQE: re-plan joins from measured shuffle sizes (broadcast only what is
    # measured small), coalesce small partitions, split skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    # Static broadcast only under a measured/estimated size bound (the
    # default); the campaign dimension and pre-aggregated sides fit, facts never.
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
}


def get_or_create_session(
    master: str | None = None,
    app_name: str = "marketspark",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(WAREHOUSE_CONF)
    conf["spark.ui.enabled"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (or set on the context); an error if there is none."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("give a folder that all executors share, or name one in spark.checkpoint.dir")
    return folder


def scratch_root(spark: SparkSession, name: str) -> str:
    """A folder for written intermediate tables, under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name)
