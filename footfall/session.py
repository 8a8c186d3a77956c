"""Session settings the engine's plans are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime coalescing of small shuffle partitions, splitting of skewed join partitions
    # and switching to broadcast joins by measured size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Join sides that turn out to be so small at run time are broadcast.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Without the Python call site of every Column, plans are built twice as fast.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(app_name: str = "footfall", master: str | None = None, **settings: str) -> SparkSession:
    """A Spark session with the engine's settings; ``settings`` override them."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
