"""Given tables and intermediate tables of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where a session has none, as in tests, a folder in its warehouse, which is shared too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_work").rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Run ``df`` once, as a Parquet table in the shared folder, and return that table.

    It cuts the lineage, survives the loss of executors, and has a size that the planner
    knows, so that Spark broadcasts it only if it is small. The table stays until the
    owner of the shared folder cleans it. ``options`` are the Parquet writer's.
    """
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 22
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
