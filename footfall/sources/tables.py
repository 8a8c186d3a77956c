"""Named and intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from footfall.operators.users import user_facts


@contextmanager
def work_folder(spark: SparkSession, beside: str) -> Iterator[str]:
    """A folder for intermediate tables, for the length of a block; deleted at its end.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``, or else in
    ``beside``: a folder of results, which all executors reach as well.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{beside.rstrip('/')}/_work"
    folder = f"{shared.rstrip('/')}/footfall/{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written_table(df: DataFrame, name: str, folder: str) -> DataFrame:
    """Run ``df`` once, as a Parquet table in ``folder``, and return that table.

    For results that several queries read: it cuts the lineage, survives the loss of
    executors, and later reads fetch only the columns they use. The caller owns the folder.
    """
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def register_views(
    events: DataFrame, users: DataFrame | None = None, products: DataFrame | None = None
) -> None:
    """Name the tables ``events``, ``users``, ``products`` and ``user_facts`` for SQL."""
    events.createOrReplaceTempView("events")
    user_facts(events).createOrReplaceTempView("user_facts")
    if users is not None:
        users.createOrReplaceTempView("users")
    if products is not None:
        products.createOrReplaceTempView("products")
