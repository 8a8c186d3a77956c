"""Benchmark decontamination: containment search by size-partitioned MinHash sketches.

A test item is contained in a document if at least ``CONTAINMENT`` of its distinct shingles
(runs of five words) are in it. Items are far shorter than documents, so the sketches are
made for containment:

* items are partitioned by size, in powers of two. An item of n shingles is sketched by its
  k = floor((1 - CONTAINMENT) * n) + 1 lowest shingle hashes. A document that contains the item
  lacks fewer than k of its shingles, so it has one of the sketch: no item is missed;
* each partition has a bound, the highest hash of its sketches. A document looks up only
  those of its shingles that lie under the bound of the partitions whose items are small
  enough for it, which is a fraction of its shingles.

Candidates are verified by the exact shingles. Built-in expressions only; the long side is
never shuffled as long as the planner finds the sketches, or the candidates, small enough
to broadcast, and joined by shuffles beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.tables import written

SHINGLE, CONTAINMENT = 5, 0.8


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case; none for NULL."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.array_remove(parts, "")


def _windows(w: Column, of) -> Column:
    """``of`` the words of each shingle, in text order; none below five words."""
    starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0)))
    return F.transform(
        starts, lambda first, i: of(first, *(F.get(w, i + k) for k in range(1, SHINGLE)))
    )


def hashes(text: Column) -> Column:
    """64-bit hashes of the shingles, in text order."""
    return _bind(words(text), lambda w: _windows(w, F.xxhash64))


def shingles(text: Column) -> Column:
    """The distinct shingles themselves."""
    return F.array_distinct(
        _bind(words(text), lambda w: _windows(w, lambda *x: F.concat_ws(" ", *x)))
    )


def _item() -> Column:
    """An item is its id, which may be NULL, and its text."""
    return F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("_item")


def sketches(items: DataFrame) -> DataFrame:
    """_item, its number of shingles n, its size partition, and a row per hash of its sketch."""
    sized = items.select(
        _item(),
        F.array_sort(F.array_distinct(hashes(F.col("text")))).alias("_hashes"),
    ).withColumn("n", F.size("_hashes"))
    kept = F.floor(F.lit(1 - CONTAINMENT) * F.col("n") + 1e-9).cast("int") + 1
    return sized.where("n > 0").select(
        "_item",
        "n",
        F.floor(F.log2("n")).cast("int").alias("partition"),
        F.explode(F.slice("_hashes", F.lit(1), kept)).alias("_hash"),
    )


def _bound(n: Column, bounds: dict[int, int]) -> Column:
    """The highest hash that a document of n shingles looks up; null if no item fits."""
    fits = [
        F.when(n >= F.lit(CONTAINMENT * (1 << size) - 1e-9), F.lit(bound).cast("bigint"))
        for size, bound in sorted(bounds.items())
    ]
    nothing = F.lit(None).cast("bigint")
    return F.greatest(nothing, nothing, *fits)


def candidates(documents: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs (_id, _text_hash, _item) that share a hash of the item's sketch."""
    per_size = sketch.groupBy("partition").agg(F.max("_hash").alias("bound"))
    # One row per power of two, 31 at most.
    bounds = {r["partition"]: r["bound"] for r in per_size.collect()}
    looked_up = documents.select(
        F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_text_hash"),
        hashes(F.col("text")).alias("_all"),
    ).select(
        "_id",
        "_text_hash",
        F.size("_all").alias("_n"),
        F.explode(
            _bind(
                _bound(F.size("_all"), bounds),
                lambda bound: F.filter("_all", lambda h: h <= bound),
            )
        ).alias("_hash"),
    )
    joined = looked_up.join(sketch, "_hash").where(F.col("_n") >= F.col("n") * CONTAINMENT - 1e-9)
    return joined.select("_id", "_text_hash", "_item").distinct()


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, _own (hash of the text), item_id and containment of each item that is in a text."""
    named, known = documents.select("doc_id", "text"), items.select("item_id", "text").distinct()
    pairs = written(candidates(named, written(sketches(known), "sketches")), "candidates")
    whole = known.select(_item().alias("_of"), "item_id", shingles(F.col("text")).alias("_wanted"))
    texts = named.select("doc_id", F.xxhash64("text").alias("_own"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_text_hash"))
    both = texts.join(pairs, same).join(whole, F.col("_item") == F.col("_of"))
    shared = F.size(F.array_intersect("_wanted", shingles(F.col("text"))))
    measured = both.select(
        "doc_id", "_own", "item_id", (shared / F.size("_wanted")).alias("containment")
    )
    return measured.where(F.col("containment") >= CONTAINMENT - 1e-9)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id and containment of each item found in a document's whole text.

    Rows of equal doc_id and text give one row per item. A NULL or short text contains
    nothing; an item of fewer than five words has no shingle and is found nowhere; items of
    equal text are each found, and so are items without id, as NULL. Texts of one item_id are
    measured each for itself, and so are texts of one doc_id; equal rows are given once. Empty
    tables give no rows. Other columns don't matter.
    """
    return found(documents, items).select("doc_id", "item_id", "containment").distinct()


def clean_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``documents`` that contain no item, with their columns as they are."""
    leaky = found(documents, items).select(F.col("doc_id").alias("_id"), F.col("_own").alias("_hash"))
    leaky = written(leaky.distinct(), "leaks")
    given = documents.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("_own"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash"))
    return given.join(leaky, same, "left_anti").select("_row.*")


#: The same pairs, from all shingles.
ORACLE_SQL = f"""
WITH items AS (
  SELECT row_number() OVER () AS k, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
item_words AS (
  SELECT k, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
  FROM items),
item_shingles AS (
  SELECT DISTINCT k, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
  FROM item_words, unnest(range(1, len(w) - {SHINGLE - 2})) AS t(i)),
doc_words AS (
  SELECT r, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
  FROM docs),
doc_shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
  FROM doc_words, unnest(range(1, len(w) - {SHINGLE - 2})) AS t(i)),
sizes AS (SELECT k, count(*) AS n FROM item_shingles GROUP BY k),
found AS (
  SELECT r, k, CAST(count(*) AS DOUBLE) / n AS containment
  FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (k)
  GROUP BY r, k, n HAVING count(*) >= {CONTAINMENT} * n)
SELECT DISTINCT doc_id, item_id, containment FROM found JOIN docs USING (r) JOIN items USING (k)"""
