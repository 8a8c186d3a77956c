"""Sets of tables that readers see whole: written first, named in a manifest last.

A publication is one file ``_manifest/<number>.json`` under a folder, with any content. The file is
written beside and renamed to its number, so that it exists whole or not at all, and a number
is taken once: of two writers one fails. Readers take the highest number. Tables lie in
folders that no later run writes to.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

MANIFEST = "_manifest"


class PublicationConflict(RuntimeError):
    """Another writer published first."""


class Folder:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self.path = path.rstrip("/")
        self._jvm = context._jvm
        self._conf = context._jsc.hadoopConfiguration()

    def _at(self, name: str) -> tuple[Any, Any]:
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self._conf), path

    def names(self, name: str = "") -> list[str]:
        files, path = self._at(name)
        if not files.exists(path):
            return []
        return sorted(status.getPath().getName() for status in files.listStatus(path))

    def read(self, name: str) -> str:
        files, path = self._at(name)
        stream = files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Write a file under a name that is free; false if it isn't."""
        files, path = self._at(name)
        _, beside = self._at(f"{MANIFEST}/.{uuid.uuid4().hex}")
        stream = files.create(beside)
        stream.write(bytearray(text.encode()))
        stream.close()
        if files.exists(path) or not files.rename(beside, path):
            files.delete(beside, False)
            return False
        return True

    def delete(self, name: str = "") -> None:
        files, path = self._at(name)
        files.delete(path, True)


def _numbers(folder: Folder) -> list[int]:
    return sorted(int(n[:-5]) for n in folder.names(MANIFEST) if n.endswith(".json") and n[:-5].isdigit())


def published(spark: SparkSession, path: str) -> tuple[int, Any]:
    """(number, content) of the last publication; (0, None) if there is none."""
    folder = Folder(spark, path)
    numbers = _numbers(folder)
    if not numbers:
        return 0, None
    return numbers[-1], json.loads(folder.read(f"{MANIFEST}/{numbers[-1]:08d}.json"))


def publish(spark: SparkSession, path: str, content: Any, after: int) -> int:
    """Publish what follows on publication ``after``; returns its number."""
    name = f"{MANIFEST}/{after + 1:08d}.json"
    if not Folder(spark, path).write_new(name, json.dumps(content, sort_keys=True)):
        raise PublicationConflict(f"{path}: publication {after + 1} is there already")
    return after + 1


def withdraw(spark: SparkSession, path: str, keep: int) -> tuple[list[Any], list[Any]]:
    """Take back all publications but the last ``keep``; the contents of (those, the rest)."""
    folder = Folder(spark, path)
    names = [f"{MANIFEST}/{number:08d}.json" for number in _numbers(folder)]
    contents = [json.loads(folder.read(name)) for name in names]
    for name in names[:-keep]:
        folder.delete(name)
    return contents[:-keep], contents[-keep:]
