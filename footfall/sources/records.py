"""CSV with line breaks in quotes, read by many tasks.

Files are split at line breaks, as plain text files are. Whether a split begins inside a quoted
cell follows from the quotes before it: each split's quotes, modulo two, are a map of
"inside" to "inside", and the maps of a file's splits compose in a scan over one row per split.
With it each task knows where the records of its split begin and end. Only records that go
over the end of a split are put together elsewhere, from their fragments.

Quotes stand around whole cells and are doubled within, as ``write_artifact`` writes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: What a piece is: a whole record, the end of one that began before its split, the begin of one
#: that goes on in the next, or a part of one that does neither end nor begin in its split.
RECORD, HEAD, TAIL, MIDDLE = range(4)
PIECES = "file string, start bigint, kind int, first boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the order of their split; carriage returns stay."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def splits(lines: DataFrame) -> DataFrame:
    """``file, start, inside, broken``: does a split begin inside quotes, and does it or the next."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    # one row per split of a file
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    return odd.select(
        "file", "start", inside.alias("inside"), (inside | (F.sum("odd").over(upto) % 2 == 1)).alias("broken")
    )


def _pieces(lines: DataFrame, whole: bool) -> DataFrame:
    """The records of each split, or else its fragments of records."""

    def of_split(values: list[str], counts: np.ndarray, inside: bool) -> Iterator[tuple[int, str]]:
        outside = (np.cumsum(counts) + inside) % 2 == 0
        ends = np.flatnonzero(outside) + 1
        if inside and not len(ends):
            yield MIDDLE, "\n".join(values)
            return
        begin = 0
        for end in ends.tolist():
            text = values[begin] if end == begin + 1 else "\n".join(values[begin:end])
            yield (HEAD if inside and not begin else RECORD), text
            begin = end
        if begin < len(values):
            yield TAIL, "\n".join(values[begin:])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, fresh, held, held_counts = None, False, True, [], []

        def told(values: list[str], counts: np.ndarray, last: bool) -> list[tuple]:
            """Pieces of the split so far; what is open is held, unless the split is at its end."""
            nonlocal inside, fresh, held, held_counts
            outside = np.flatnonzero((np.cumsum(counts) + inside) % 2 == 0)
            upto = len(values) if last else (int(outside[-1]) + 1 if len(outside) else 0)
            found = list(of_split(values[:upto], counts[:upto], inside)) if upto else []
            out = [(*key, k, fresh and i == 0, t) for i, (k, t) in enumerate(found)]
            held, held_counts = values[upto:], counts[upto:]
            if found:
                fresh, inside = False, False
            return [r for r in out if (r[2] == RECORD) == whole]

        for batch in batches:
            found = []
            files, starts = batch.column("file"), batch.column("start").to_numpy()
            names = files.to_numpy(zero_copy_only=False)
            counts = pc.count_substring(batch.column("value"), '"').to_numpy()
            change = np.flatnonzero((starts[1:] != starts[:-1]) | (names[1:] != names[:-1])) + 1
            for begin, end in zip([0, *change], [*change, batch.num_rows], strict=True):
                if begin == end:
                    continue
                if key != (names[begin], starts[begin]):
                    if key is not None:
                        found += told(held, np.array(held_counts, int), True)
                    key = (names[begin], int(starts[begin]))
                    inside, fresh, held, held_counts = bool(batch.column("inside")[begin].as_py()), True, [], []
                values = held + batch.column("value").slice(begin, end - begin).to_pylist()
                found += told(values, np.concatenate((held_counts, counts[begin:end])).astype(int), False)
            if found:
                yield _batch(found)
        if key is not None and len(held):
            found = told(held, np.array(held_counts, int), True)
            if found:
                yield _batch(found)

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["file", "start", "kind", "first", "text"])

    return lines.mapInArrow(rows, PIECES)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, header, text``: the records of all files, and whether one is its file's first.

    Nothing runs before it is read. The table of splits is as long as there are splits, and is
    sent to all tasks, which keeps the lines' order.
    """
    lines = _lines(spark, path)
    of_file = splits(lines)
    marked = lines.join(F.broadcast(of_file), ["file", "start"])
    whole = _pieces(marked.select("value", "file", "start", "inside"), True)
    broken = marked.where("broken").select("value", "file", "start", "inside")
    fragments = _pieces(broken, False)
    # a record goes from its tail over any middles to the next head
    in_order = Window.partitionBy("file").orderBy("start", "place")
    place = F.when(F.col("kind") == TAIL, 1).otherwise(0)
    numbered = fragments.withColumn("place", place).withColumn(
        "number", F.sum("place").over(in_order)
    )
    parts = F.array_sort(F.collect_list(F.struct("start", "place", "text")))
    joined = numbered.groupBy("file", "number").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"),
        F.bool_or(F.col("first") & (F.col("kind") == TAIL) & (F.col("start") == 0)).alias("header"),
    )
    header = F.col("first") & (F.col("start") == 0)
    return whole.select("file", header.alias("header"), "text").unionByName(
        joined.select("file", "header", "text")
    )


def parsed(table: DataFrame, names: list[str], options: dict[str, object]) -> DataFrame:
    """The columns of ``records``, all text. A record of another length than the header fails,
    and so does a file whose header isn't ``names``."""
    declared = T.StructType([T.StructField(name, T.StringType()) for name in names])
    told = {k: str(v) if not isinstance(v, bool) else str(v).lower() for k, v in options.items()}
    told |= {"mode": "FAILFAST", "multiLine": "true", "columnPruning": "false"}
    told.pop("header", None)
    text = F.regexp_replace("text", "\r$", "")
    row = F.from_csv(F.when(F.col("header"), F.regexp_replace(text, "^﻿", "")).otherwise(text), _ddl(declared), told)
    rows = table.where(text != "").select("header", "file", row.alias("row"))
    found = F.array(*[F.col("row")[name] for name in names])
    wrong = F.raise_error(F.concat(F.lit("MALFORMED_CSV_RECORD: another header in "), F.col("file")))
    same: Column = found == F.array(*map(F.lit, names))
    return rows.where(
        F.when(~F.col("header"), True).when(same, False).otherwise(wrong.cast("boolean"))
    ).select(*[F.col("row")[name].alias(name) for name in names])


def _ddl(declared: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in declared)
