"""Writers for result tables and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.sources.readers import CSV_FORM


def write_artifact(
    df: DataFrame, out_dir: str, name: str, fmt: str = "csv", single_file: bool = False
) -> None:
    """Write a result table to ``out_dir/name``, replacing an earlier one.

    ``single_file`` is for report tables, whose rows the definitions bound; any other table
    keeps its partitions. CSV doubles quotes and keeps blanks, as ``read_artifact`` reads it.
    """
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(**CSV_FORM)
    writer.save(f"{out_dir}/{name}")


def write_events(events: DataFrame, path: str) -> None:
    """Write a log as Parquet partitioned by day, for date-bounded reads.

    ``rebalance`` lets adaptive execution choose the files from measured sizes: small
    days share a task, and a day that holds a large share of the log is split over many.
    """
    (
        events.withColumn("event_date", F.to_date("event_timestamp"))
        .hint("rebalance", "event_date")
        .write.mode("overwrite")
        .partitionBy("event_date")
        .parquet(path)
    )
