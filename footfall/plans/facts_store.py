"""Per-user facts that are kept up to date as a log grows.

Every batch of events becomes two small tables: its own periods, and the facts of the users it
has events of, computed from all their periods. Nothing is written again; a user's facts are
those of the last batch that touched them. A batch counts once it is in the manifest, so a
run that stops halfway changes nothing, and a batch is never counted twice.

``compact`` merges all batches into one, to keep reads short. Facts are those of the whole
log after every batch, in whatever order its events came.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.operators.users import (
    facts_of_periods,
    merge_periods,
    merged_periods,
    period_length,
    user_periods,
)
from footfall.sources.publication import Folder, publish, published, withdraw


class FactsStore:
    """A folder of ``user_periods`` and ``user_facts`` by batch.

    ``options`` are ``user_facts``'s (steps and windows). They are kept with the first batch;
    a store that is opened with others is refused.
    """

    def __init__(self, spark: SparkSession, path: str, **options: object):
        self.spark, self.path = spark, path.rstrip("/")
        self.options = {k: list(v) if isinstance(v, tuple) else v for k, v in options.items()}
        shape = {k: v for k, v in options.items() if k in ("retention_days", "attribution_days")}
        self._length = period_length(**shape)
        self._steps = {k: v for k, v in options.items() if k == "steps"}

    def _state(self) -> tuple[int, dict]:
        number, content = published(self.spark, self.path)
        content = content or {"options": self.options, "batches": [], "parts": []}
        if content["options"] != self.options:
            raise ValueError(f"{self.path} was made with {content['options']}, not {self.options}")
        return number, content

    def _tables(self, name: str, parts: list[str]) -> DataFrame | None:
        tables = [
            self.spark.read.parquet(f"{self.path}/{part}/{name}").withColumn("part", F.lit(place))
            for place, part in enumerate(parts)
        ]
        whole = tables[0] if tables else None
        for table in tables[1:]:
            whole = whole.unionByName(table)
        return whole

    def batches(self) -> list[str]:
        """Names of the batches that count."""
        return self._state()[1]["batches"]

    def append(self, events: DataFrame, batch: str) -> bool:
        """Add a batch of events, of any time; false if a batch of that name counts already."""
        number, content = self._state()
        if batch in content["batches"]:
            return False
        part = f"parts/{uuid.uuid4().hex}"
        new = user_periods(events, self._length, **self._steps)
        new.write.parquet(f"{self.path}/{part}/periods")
        delta = self.spark.read.parquet(f"{self.path}/{part}/periods")
        so_far = self._tables("periods", content["parts"])
        mine = delta
        if so_far is not None:
            touched = delta.select("user_id").distinct()
            mine = merge_periods(so_far.drop("part").join(touched, "user_id", "left_semi"), delta)
        facts_of_periods(mine, **self._windows()).write.parquet(f"{self.path}/{part}/facts")
        content = {**content, "batches": [*content["batches"], batch], "parts": [*content["parts"], part]}
        publish(self.spark, self.path, content, number)
        return True

    def _windows(self) -> dict:
        return {k: tuple(v) if k == "retention_days" else v for k, v in self.options.items()}

    def periods(self) -> DataFrame:
        """``user_periods`` of all batches."""
        return self._whole("periods", merged_periods)

    def facts(self) -> DataFrame:
        """``user_facts`` of all batches: of each user the last row."""

        def last(table: DataFrame) -> DataFrame:
            names = [c for c in table.columns if c not in ("user_id", "part")]
            of_user = table.groupBy("user_id").agg(F.max_by(F.struct(*names), "part").alias("f"))
            return of_user.select("user_id", "f.*")

        return self._whole("facts", last)

    def _whole(self, name: str, merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
        parts = self._state()[1]["parts"]
        if not parts:
            raise ValueError(f"{self.path} has no batch")
        table = self._tables(name, parts)
        return table.drop("part") if len(parts) == 1 else merged(table)

    def compact(self, keep: int = 2) -> None:
        """Merge all batches into one part; the folders of older publications are deleted.

        Readers of the last ``keep`` publications, this one among them, aren't disturbed.
        """
        number, content = self._state()
        if len(content["parts"]) > 1:
            part = f"parts/{uuid.uuid4().hex}"
            self.periods().write.parquet(f"{self.path}/{part}/periods")
            self.facts().write.parquet(f"{self.path}/{part}/facts")
            publish(self.spark, self.path, {**content, "parts": [part]}, number)
        gone, rest = withdraw(self.spark, self.path, keep)
        held = {part for content in rest for part in content["parts"]}
        for part in {part for content in gone for part in content["parts"]} - held:
            Folder(self.spark, self.path).delete(part)
