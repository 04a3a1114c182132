"""Session settings the plans are written for."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: One row of ``files`` holds a whole source text, expands to several arrays of its size and
#: costs much CPU for its bytes, so scan tasks, shuffle partitions and Arrow batches are kept
#: smaller than Spark's defaults.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.session.timeZone": "UTC",
}

#: Set before the session starts: recording a Python call site for every column makes long
#: expressions slow to build.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply all settings to a session builder."""
    for key, value in (SETTINGS | STATIC_SETTINGS).items():
        builder = builder.config(key, value)
    return builder


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and every executor can reach.

    A session on one machine may leave the setting out; its folder is beside the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
