"""Session settings the jobs are tuned for, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings a cluster session should carry.  Joins are never hinted: Spark
# broadcasts a side only when its measured size is under the threshold, and the
# adaptive planner splits hot join partitions, also where that costs a shuffle.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "true",  # see sources.bucketed.meet_in_buckets
}

# Only settable while a session is built.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}  # no stack trace per call


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **AT_START, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings to a session somebody else created."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, name: str, shared: str | None = None) -> str:
    """A fresh folder for written intermediates.

    Under ``shared`` if given, else under the folder of ``spark.checkpoint.dir``, else
    under the session's warehouse: places that all executors reach, on any master.
    """
    shared = shared or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
