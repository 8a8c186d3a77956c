"""Near-duplicate documents: Order MinHash, verified by banded alignment.

Two documents are near duplicates if their sequences of word shingles (five words) align:
aligned shingles / (all shingles of both - aligned) >= ``SIMILARITY``. Without repeats and
moved passages that is the Jaccard similarity of the shingles.

* Documents of equal text are one node, whatever their number.
* A node's sketch samples, per hash function, the few shingles of lowest hash, each labelled
  by its occurrence, and keeps them in text order. Nodes meet in a bucket if such a sample
  agrees. Longer documents are sampled by six shingles and forty functions, short ones by
  two and twenty; lengths near the limit take both, so that no pair falls between. At a
  similarity of 0.8 a pair is missed with a probability of about one in 100,000.
* In each bucket all nodes are aligned with one, so that a group of thousands of copies costs
  thousands of alignments and not millions. It is the node that shares buckets with most
  others: the original, where a group has one, to which its copies are nearer than to each
  other.
* Where a bucket then still holds more than one connected component, links across them are
  found exactly. A similar pair has at least k = ceil(4/9 (n + m)) of its n and m shingles in
  common. So, in any one order of all shingles, it shares one of the first n - k + 1 of the
  one and m - k + 1 of the other. With rare shingles first, these are a document's own:
  neither those with a common passage nor distant copies of one original meet in them.
* Components are labelled by joins, with pointer jumping.

Texts move only for nodes that share a bucket with another. Intermediate tables are in the
shared folder.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.tables import small_batches, written

SHINGLE, SIMILARITY = 5, 0.8
#: Sampled shingles and hash functions: from ``LONG_FROM`` shingles on, and up to ``SHORT_TO``.
#: SHORT_TO * SIMILARITY >= LONG_FROM: a similar pair has one of the two in common.
LONG, LONG_FROM = (6, 40), 16
SHORT, SHORT_TO = (2, 20), 20
MAX_WORDS = 1 << 19

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash of a word; forgets all beyond ``MAX_WORDS``."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        n = self[word] = xxhash.xxh64_intdigest(word.encode())
        return n


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return values ^ (values >> np.uint64(29))


def shingle_hashes(text: str, hashes: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the shingles in text order; fewer than five words are one shingle."""
    words = np.array([hashes[w] for w in _WORD.findall(text.lower())], np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    found = np.full(n, min(len(words), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(words))):
        found = _mixed(found + words[k : k + n])
    return found


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingles made distinct by the number of their occurrence in the text."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    if first.all():
        return shingles
    begins = np.flatnonzero(first)
    occurrence = np.arange(len(ranked)) - np.repeat(begins, np.diff([*begins, len(ranked)]))
    out = np.empty_like(shingles)
    out[order] = ranked + _mixed(occurrence.astype(np.uint64)) * (occurrence > 0)
    return out


def sketch(shingles: np.ndarray) -> list[np.ndarray]:
    """The bucket keys of a document: one for each hash function's ordered sample."""
    n, keys = len(shingles), []
    if not n:
        return [np.empty(0, np.uint64)]
    distinct = labelled(shingles)
    for kind, ((sampled, functions), used) in enumerate(
        ((LONG, n >= LONG_FROM), (SHORT, n <= SHORT_TO))
    ):
        if not used:
            continue
        size = min(sampled, n)
        seeds = _mixed(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(2 * kind + 3))
        at_once = max(1, (1 << 20) // n)  # hash functions whose values are held together
        for begin in range(0, functions, at_once):
            some = seeds[begin : begin + at_once, None]
            values = (distinct ^ some) * (some | np.uint64(1))
            places = np.argpartition(values, size - 1, axis=1)[:, :size]
            places.sort(axis=1)  # text order
            chosen = distinct[places]
            key = some[:, 0]
            for column in chosen.T:
                key = _mixed(key + column)
            keys.append(key)
    return keys


def aligned(a: list[int], b: list[int], least: float) -> int:
    """How many elements the best alignment of two sequences has in common.

    Only a band around the diagonal is looked at: two sequences that have ``least`` of their
    union in common can't drift further apart than what they don't share. The band's cells
    of a row are the bits of one number, in which a 0 marks a step up.
    """
    begin, end = 0, 0
    short = min(len(a), len(b))
    while begin < short and a[begin] == b[begin]:
        begin += 1
    while end < short - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    same = begin + end
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a or not b:
        return same
    # common >= least * (both - common), so at most this many of both are not aligned
    total = len(a) + len(b) + 2 * same
    width = int((1 - least) / (1 + least) * total) + 1
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    low, high = 0, min(len(a), width + 1)  # columns of the row's band
    row = (1 << high) - 1
    for j, x in enumerate(b):
        new_low, new_high = max(0, j - width), min(len(a), j + width + 1)
        if new_low >= len(a):
            break
        if new_high > high:
            row |= ((1 << (new_high - high)) - 1) << (high - low)
            high = new_high
        if new_low > low:
            dropped = row & ((1 << (new_low - low)) - 1)
            same += (new_low - low) - dropped.bit_count()
            row >>= new_low - low
            low = new_low
        size = high - low
        if mask := masks.get(x, 0) >> low & ((1 << size) - 1):
            hit = row & mask
            row = ((row + hit) | (row - hit)) & ((1 << size) - 1)
    return same + (high - low) - row.bit_count()


def _shared(a: list[int], b: list[int]) -> int:
    """No alignment has more in common than this: equal shingles, wherever they are."""
    once, other = set(a), set(b)
    both = len(once & other)
    if len(once) == len(a) or len(other) == len(b):
        return both  # one of them has no repeats
    return (Counter(a) & Counter(b)).total()


def similarity(a: list[int], b: list[int], least: float = SIMILARITY) -> float:
    """Aligned shingles over the union; 0 if lengths or equal shingles rule ``least`` out."""
    if not a or not b or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    most = _shared(a, b)
    if most < least * (len(a) + len(b) - most):
        return 0.0
    common = aligned(a, b, least)
    return common / (len(a) + len(b) - common)


# --- Spark --------------------------------------------------------------------------


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart; NULL counts as an empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _name(doc_id: Column) -> Column:
    """A doc_id as text, so that NULL joins like any other."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, _key and _buckets of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in small_batches(batches, "text"):
            keys = []
            for text in batch.column("text").to_pylist():
                found = shingle_hashes(text or "", hashes)
                keys.append(np.concatenate(sketch(found)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "_key")),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "_key", "_buckets"],
            )

    given = documents.select("doc_id", "text", text_key(F.col("text")).alias("_key"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(rows, f"doc_id {kind}, _key binary, _buckets array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, recent = _Hashes(), OrderedDict()

        def shingles(key: bytes, text: str) -> list[int]:
            found = recent.pop(key, None)
            if found is None:
                found = shingle_hashes(text, hashes).tolist()
            recent[key] = found
            if len(recent) > 16:
                recent.popitem(last=False)
            return found

        for batch in small_batches(small_batches(batches, "_text_a"), "_text_b"):
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            good = [
                similarity(shingles(ka, ta), shingles(kb, tb)) >= SIMILARITY
                for ka, kb, ta, tb in zip(a, b, text_a, text_b, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good)], ["a", "b", "good"])

    def of(side: str) -> DataFrame:
        return texts.select(F.col("_key").alias(side), F.col("_text").alias(f"_text_{side}"))

    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "_text_a", "_text_b")
    return both.mapInArrow(rows, "a binary, b binary, good boolean").where("good").select("a", "b")


def _told(shingles: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shingles.view(np.int64)), pa.array(counts)], ["_shingle", "_count"]
    )


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that make out 2**-20 of all or more, 2**20 at most, and how often they occur.

    Shingles that are met once in a batch of texts are left out; that makes the order of
    shingles less sharp, but any order is right.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = _Hashes(), 0
        for batch in small_batches(batches, "_text"):
            found = [labelled(shingle_hashes(t, hashes)) for t in batch.column("_text").to_pylist()]
            shingles, counts = np.unique(np.concatenate(found), return_counts=True)
            total += int(counts.sum())
            yield _told(shingles[counts > 1], counts[counts > 1])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], ["_shingle", "_count"])

    counted = texts.mapInArrow(rows, "_shingle bigint, _count bigint")
    counted = written(counted.groupBy("_shingle").agg(F.sum("_count").alias("_count")), "shingles")
    total = counted.where(F.col("_shingle").isNull()).select("_count").first()
    least = max(4, (total["_count"] if total else 0) >> 20)
    often = counted.where(F.col("_shingle").isNotNull() & (F.col("_count") > least)).toArrow()
    shingles = often.column("_shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], often.column("_count").to_numpy()[order]


def across_components(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different _label that may be similar, with their labels.

    ``texts`` has _key, _label and _text. The order is (how often a shingle occurs, hash). A
    partner has 0.8 n shingles at least, so that no more than the first n - ceil(0.8 n) + 1
    can matter; which of them do for a pair follows from both numbers.
    """
    sent = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (often, counts) = _Hashes(), sent.value
        for batch in small_batches(batches, "_text"):
            owners, sizes, places, first = [], [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                shingles = np.sort(labelled(shingle_hashes(text, hashes)))
                n = len(shingles)
                at = np.minimum(np.searchsorted(often, shingles), max(0, len(often) - 1))
                known = often[at] == shingles if len(often) else np.zeros(n, bool)
                rank = np.where(known, counts[at], 0) if len(often) else np.zeros(n, np.int64)
                used = n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1 if n else 0
                chosen = shingles[np.argsort(rank, kind="stable")[:used]]
                first.append(chosen.view(np.int64))
                owners.append(np.full(len(chosen), i))
                sizes.append(np.full(len(chosen), n, np.int32))
                places.append(np.arange(len(chosen), dtype=np.int32))
            owner = pa.array(np.concatenate(owners))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").take(owner),
                    batch.column("_label").take(owner),
                    pa.array(np.concatenate(sizes)),
                    pa.array(np.concatenate(places)),
                    pa.array(np.concatenate(first)),
                ],
                ["_key", "_label", "_n", "_p", "_shingle"],
            )

    kinds = "_key binary, _label binary, _n int, _p int, _shingle bigint"
    firsts = written(texts.select("_key", "_label", "_text").mapInArrow(rows, kinds), "firsts")
    mixed = firsts.groupBy("_shingle").agg(
        F.min("_label").alias("_low"), F.max("_label").alias("_high")
    )
    firsts = firsts.join(mixed.where("_low <> _high").select("_shingle"), "_shingle")

    def side(key: str) -> DataFrame:
        named = {"_key": key, "_label": f"_l{key}", "_n": f"_n{key}", "_p": f"_p{key}"}
        return firsts.withColumnsRenamed(named)

    near = F.least("_na", "_nb") >= SIMILARITY * F.greatest("_na", "_nb")
    apart = (F.col("a") < F.col("b")) & (F.col("_la") != F.col("_lb"))
    common = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("_na") + F.col("_nb")) - 1e-9)
    early = (F.col("_pa") <= F.col("_na") - common) & (F.col("_pb") <= F.col("_nb") - common)
    pairs = side("a").join(side("b"), "_shingle").where(apart & near & early)
    return pairs.select("a", "b", "_la", "_lb").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of the nodes of edges (a, b); the label is the component's least node.

    Each round takes the least label among a node and its neighbours, and then the label's
    own label, so that rounds grow with the logarithm of a component's diameter.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = written(both, f"{name}-edges")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")),
        f"{name}-0",
    )
    step = 0
    while True:
        step += 1
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_least"))
        met = labels.join(seen, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("_old"), F.least("label", "_least").alias("_new")
        )
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_next"))
        moved = met.join(jump, F.col("_new") == F.col("_at"), "left").select(
            "node", F.least("_new", "_next").alias("label"), "_old"
        )
        moved = written(moved, f"{name}-{step}")
        labels = moved.select("node", "label")
        if moved.where(F.col("label") != F.col("_old")).isEmpty():
            return labels


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, _key, _class (of the key) of every row; near duplicates have one class.

    NULL texts are copies of empty ones. A text without words is like no other text.
    """
    drawn = written(sketches(documents.select("doc_id", "text")), "sketches")
    nodes = written(
        drawn.groupBy("_key").agg(
            F.min("doc_id").alias("_id"), F.first("_buckets").alias("_buckets")
        ),
        "nodes",
    )
    met = nodes.select("_key", F.explode("_buckets").alias("_bucket"))
    shared = met.groupBy("_bucket").agg(F.count("*").alias("_of")).where("_of > 1")
    met = written(met.join(shared, "_bucket"), "shared")  # only buckets of two and more
    known = met.join(met.groupBy("_key").agg(F.sum("_of").alias("_met")), "_key")
    most = known.groupBy("_bucket").agg(F.max(F.struct("_met", "_key"))["_key"].alias("_first"))
    met = written(met.select("_bucket", "_key").join(most, "_bucket"), "buckets")
    first = (
        met.where(F.col("_key") != F.col("_first"))
        .select(F.col("_first").alias("a"), F.col("_key").alias("b"))
        .distinct()
    )
    first = written(first, "pairs")

    # texts of the nodes that share a bucket, each once
    wanted = met.select("_key").distinct().join(nodes.select("_key", "_id"), "_key")
    wanted = written(wanted.select("_key", _name(F.col("_id")).alias("_name")), "wanted")
    wanted = wanted.hint("merge")  # it grows with the documents, so it is never broadcast
    texts = (
        documents.select(
            text_key(F.col("text")).alias("_key"),
            _name(F.col("doc_id")).alias("_name"),
            F.coalesce("text", F.lit("")).alias("_text"),
        )
        .join(wanted, ["_key", "_name"])
        .dropDuplicates(["_key", "_name"])
        .select("_key", "_text")
    )
    texts = written(texts, "texts")
    edges = written(verified(first, texts), "edges")
    labels = components(edges)

    # nodes of buckets with different components, and pairs of them across components
    labelled_met = met.select("_bucket", "_key").join(labels, F.col("_key") == F.col("node"), "left")
    labelled_met = labelled_met.select("_bucket", "_key", F.coalesce("label", "_key").alias("_label"))
    mixed = labelled_met.groupBy("_bucket").agg(
        F.min("_label").alias("_low"), F.max("_label").alias("_high")
    )
    mixed = mixed.where("_low <> _high").select("_bucket")
    still_open = labelled_met.join(mixed, "_bucket").select("_key", "_label").distinct()
    still_open = written(texts.join(still_open, "_key"), "open")
    across = written(across_components(still_open).join(first, ["a", "b"], "left_anti"), "across")
    more = verified(across.select("a", "b"), texts).join(across, ["a", "b"])
    joined = components(more.select(F.col("_la").alias("a"), F.col("_lb").alias("b")), "joined")

    of_key = (
        nodes.select("_key", "_id")
        .join(labels, F.col("_key") == F.col("node"), "left")
        .select("_key", "_id", F.coalesce("label", "_key").alias("_label"))
        .join(joined.select(F.col("node").alias("_n2"), F.col("label").alias("_l2")), F.col("_label") == F.col("_n2"), "left")
        .select("_key", "_id", F.coalesce("_l2", "_label").alias("_class"))
    )
    of_key = written(of_key, "classes")
    least = of_key.groupBy("_class").agg(F.min("_id").alias("class_id"))
    return drawn.select("doc_id", "_key").join(of_key.select("_key", "_class"), "_key").join(least, "_class")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and kept (the document that stays).

    One row per row of ``documents``. Repeated rows are copies; of rows that share the
    least doc_id each says kept, ``representatives`` then keeps one. A NULL doc_id stands
    for a class only if no other is in it. Other columns don't matter.
    """
    found = classes(documents)
    return found.select(
        "doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def representatives(documents: DataFrame) -> DataFrame:
    """One row of ``documents`` of each class, with its columns as they are."""
    found = classes(documents).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # Of several texts with the class's least doc_id, one stands for the class.
    stay = found.groupBy("_class").agg(
        F.min(F.struct(_name(F.col("doc_id")).alias("_name"), "_key")).alias("_stay")
    )
    stay = written(stay.select("_stay.*"), "stay")
    given = documents.select(
        F.struct("*").alias("_row"),
        text_key(F.col("text")).alias("_key"),
        _name(F.col("doc_id")).alias("_name"),
    )
    one = given.join(stay, ["_key", "_name"]).dropDuplicates(["_key", "_name"])
    return one.select("_row.*")
