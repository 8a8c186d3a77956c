"""Substring dedup: relative Lempel-Ziv parsing against an index of reference blocks.

Words are runs of anything but ASCII blanks. Every window of ``WINDOW`` consecutive words has an
anchor: of its runs of ``GRAM`` words the one of lowest hash. Consecutive windows of one anchor
make a *block*; its words depend on the text only, so that copies of a passage fall into the
same blocks, but for the passage's ends.

* The index has a row for each anchor: the least and greatest document that has it, and whether
  all its blocks are alike. A window can only occur in two documents if its anchor does.
* Each document is factored greedily against all of the index: consecutive blocks that an
  earlier document has as well make one factor, as long as they go on.
* A factor ends in an anchor whose blocks differ between documents. Such boundary blocks are
  looked up window by window, among all windows of that anchor, so that spans end at the very
  word.

A window that occurs in a document with a smaller doc_id is so found wherever it stands. Blocks
are dealt by their anchor and pre-aggregated, and joins on it may be split, so a passage that a
third of all documents share costs one row per task; texts move only by document. Blocks and
windows are told apart by 128 bits, the anchor's hash and their own. Hashes are computed for
whole batches at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.tables import small_batches, written

#: Words of a window that counts as repeated, and of the runs that anchors are chosen from.
WINDOW, GRAM = 13, 6
#: Words whose hashes are held at once; pieces of a text overlap, so that no window is lost.
PIECE = 1 << 19
#: Bytes of text of a batch of texts.
TEXTS = 1 << 20
#: Bytes whose hashes are made at once. Longer words are hashed on their own.
BYTES = 1 << 20

_ODD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64."""
    forth, back = np.ones(BYTES + 1, np.uint64), np.ones(BYTES + 1, np.uint64)
    forth[1:], back[1:] = base, pow(base, -1, 1 << 64)
    return np.multiply.accumulate(forth), np.multiply.accumulate(back)


_FORTH, _BACK = _powers(int(_LETTERS[3]) | 1)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def word_spans(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word in texts that lie one after another."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = ~_BLANK[data]
    cut = begins[(begins > 0) & (begins < len(data))]
    cut = cut[(inside[cut] == 1) & (inside[cut - 1] == 1)]  # words that touch across texts
    change = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if len(cut):
        cut = np.unique(cut)
        starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, from polynomials over their bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + BYTES, "right"))
        if j <= i:  # a word of more than BYTES
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
            i += 1
            continue
        first, last = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_LETTERS[data[first:last]] * _FORTH[: last - first], out=sums[1:])
        at = starts[i:j] - first
        out[i:j] = (sums[ends[i:j] - first] - sums[at]) * _BACK[at]
        i = j
    return _mixed(out)


def _runs(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hash of each run of ``length`` words."""
    n = max(0, len(words) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * base + words[k : k + n]
    return _mixed(out)


class Blocks:
    """The blocks of a batch of texts: anchor, text, first window and number of windows.

    ``windows`` are the hashes of all windows, ``at`` each block's first one among them, and
    ``content`` a hash of the block: its first and last window cover all its words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends = word_spans(data, offsets[:-1])
        text = np.searchsorted(offsets, starts, "right") - 1
        self.n_words = np.bincount(text, minlength=len(offsets) - 1)
        first_word = np.concatenate(([0], np.cumsum(self.n_words)))
        found, windows, held, done = [], [np.empty(0, np.uint64)], 0, 0
        while done < len(starts):
            end = min(len(starts), done + PIECE)
            words, of = word_hashes(data, starts[done:end], ends[done:end]), text[done:end]
            n = len(words) - WINDOW + 1
            if n > 0:
                anchors, places = self._anchors(words)
                whole = of[:n] == of[WINDOW - 1 :]
                fresh = np.ones(n, bool)
                fresh[1:] = (places[1:] != places[:-1]) | ~whole[:-1]
                at = np.flatnonzero(fresh & whole)
                # a block goes on to the next fresh or broken window
                stop = np.append(np.flatnonzero(fresh | ~whole), n)
                length = stop[np.searchsorted(stop, at, "right")] - at
                found.append([anchors[at], of[at], at + done - first_word[of[at]], length, at + held])
                windows.append(_runs(words, WINDOW, _BASE))
                held += n
            if end == len(starts):
                break
            done = end - (WINDOW - 1)
        empty = [np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64)]
        self.anchor, self.text, self.begin, self.length, self.at = (
            [np.concatenate(c) for c in zip(*found, strict=True)] if found else empty
        )
        self.windows = np.concatenate(windows)
        last = self.at + self.length - 1
        self.content = _mixed(self.windows[self.at] * _ODD + self.windows[last])

    @staticmethod
    def _anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest hash of each window's runs of words, and where it stands first."""
        runs = _runs(words, GRAM, _ODD)
        n = len(words) - WINDOW + 1
        best, place = runs[:n].copy(), np.arange(n)
        for k in range(1, WINDOW - GRAM + 1):
            other = runs[k : k + n]
            lower = other < best
            best[lower] = other[lower]
            place[lower] = np.flatnonzero(lower) + k
        return best, place


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes and where each begins; NULL is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    size = len(column) + 1 + column.offset
    ends = np.frombuffer(offsets, kind, count=size)[column.offset :].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


# --- passes over the texts ------------------------------------------------------------


def anchors(named: DataFrame) -> DataFrame:
    """_anchor, _content and doc_id, a row for each block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", TEXTS):
            found = Blocks(*_bytes_of(batch.column("text")))
            of = batch.column("doc_id").take(pa.array(found.text))
            columns = [_signed(found.anchor), _signed(found.content), of]
            yield pa.RecordBatch.from_arrays(columns, ["_anchor", "_content", "doc_id"])

    return named.mapInArrow(rows, "_anchor bigint, _content bigint, doc_id bigint")


def _kept_digest(text: bytes, removed: np.ndarray | None) -> str:
    """Hex digest of the words that stay, joined by one space, a few megabytes at a time."""
    digest, first, word = hashlib.sha256(), True, 0
    for piece in _pieces(text):
        words = piece.split()
        if removed is not None:
            words, word = list(compress(words, ~removed[word : word + len(words)])), word + len(words)
        if words:
            digest.update((b"" if first else b" ") + b" ".join(words))
            first = False
    return digest.hexdigest()


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about BYTES that end at a blank."""
    done = 0
    while done < len(text):
        end = min(len(text), done + BYTES)
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        yield text[done:end]
        done = end


def _removed(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of a text's words the spans cover."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, begins, 1)
    np.subtract.at(depth, ends, 1)
    return np.cumsum(depth[:-1]) > 0


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


FACTORED = pa.schema(
    {
        "doc_id": pa.int64(),
        "_row": pa.int64(),
        "n_words": pa.int64(),
        "n_removed": pa.int64(),
        "kept_sha256": pa.string(),
        "text": pa.string(),
        "_begins": pa.list_(pa.int64()),
        "_ends": pa.list_(pa.int64()),
        "_anchor": pa.int64(),
        "begin": pa.int64(),
        "_windows": pa.list_(pa.int64()),
    }
)


def factored(marked: DataFrame) -> DataFrame:
    """One row per document, and one per boundary block.

    ``marked`` has the shared anchors of each document: ``_whole``, whose blocks are all alike
    and stand in an earlier document, and ``_differ``, whose blocks aren't. Documents without a
    boundary block are done; others have their text and the spans of whole blocks. ``_row`` numbers
    the documents.
    """

    def mask(found: Blocks, anchors: pa.Array) -> np.ndarray:
        """The blocks whose anchor is in their own text's list."""
        held = anchors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        of = np.repeat(
            np.arange(len(anchors), dtype=np.uint64),
            anchors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False),
        )
        # told apart by text; one in 2 ** 64 too many is harmless for boundaries, and whole
        # blocks are asked for by anchors that their own document has
        return np.isin(found.anchor + _mixed(found.text.astype(np.uint64)), held + _mixed(of))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 33
        for batch in small_batches(batches, "text", TEXTS):
            n = batch.num_rows
            numbers, done = np.arange(done, done + n), done + n
            data, offsets = _bytes_of(batch.column("text"))
            found = Blocks(data, offsets)
            whole, differ = (mask(found, batch.column(c)) for c in ("_whole", "_differ"))
            begins = found.begin[whole]
            ends = begins + found.length[whole] + (WINDOW - 1)
            counts = np.bincount(found.text[whole], minlength=n)
            edges = np.concatenate(([0], np.cumsum(counts)))
            open_ones = np.bincount(found.text[differ], minlength=n) > 0
            removed, digests = [], []
            for i in range(n):
                of = slice(edges[i], edges[i + 1])
                gone = _removed(found.n_words[i], begins[of], ends[of]) if counts[i] else None
                removed.append(0 if gone is None else int(gone.sum()))
                text = b"" if open_ones[i] else data[offsets[i] : offsets[i + 1]].tobytes()
                digests.append(None if open_ones[i] else _kept_digest(text, gone))
            columns = {
                "doc_id": batch.column("doc_id"),
                "_row": pa.array(numbers),
                "n_words": pa.array(found.n_words),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
                "text": batch.column("text").take(pa.array(np.arange(n), mask=~open_ones)),
                "_begins": _lists(begins, counts, pa.int64()),
                "_ends": _lists(ends, counts, pa.int64()),
            }
            yield _batch(columns, n)
            m = int(differ.sum())
            if m:
                of, length, at = pa.array(found.text[differ]), found.length[differ], found.at[differ]
                upto = np.cumsum(length)
                places = np.arange(upto[-1]) + np.repeat(at - upto + length, length)
                columns = {
                    "doc_id": batch.column("doc_id").take(of),
                    "_row": pa.array(numbers).take(of),
                    "_anchor": _signed(found.anchor[differ]),
                    "begin": pa.array(found.begin[differ]),
                    "_windows": _lists(found.windows[places].view(np.int64), length, pa.int64()),
                }
                yield _batch(columns, m)

    def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        arrays = [columns.get(f.name, pa.nulls(n, f.type)) for f in FACTORED]
        return pa.RecordBatch.from_arrays(arrays, schema=FACTORED)

    kinds = {pa.int64(): "bigint", pa.string(): "string"}
    schema = ", ".join(f"{f.name} {kinds.get(f.type, 'array<bigint>')}" for f in FACTORED)
    return marked.mapInArrow(rows, schema)


def _cleaned(spans: DataFrame) -> DataFrame:
    """The texts less ``_begins`` to ``_ends`` and the windows at ``_at``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(counts)))

        for batch in small_batches(batches, "text", TEXTS):
            data, offsets = _bytes_of(batch.column("text"))
            begins, edges = lists(batch.column("_begins"))
            ends, _ = lists(batch.column("_ends"))
            windows, places = lists(batch.column("_at"))
            counts, digests = [], []
            for i, n in enumerate(batch.column("n_words").to_numpy()):
                of, at = slice(edges[i], edges[i + 1]), windows[places[i] : places[i + 1]]
                gone = _removed(n, np.append(begins[of], at).astype(int), np.append(ends[of], at + WINDOW).astype(int))
                counts.append(int(gone.sum()))
                digests.append(_kept_digest(data[offsets[i] : offsets[i + 1]].tobytes(), gone))
            columns = [batch.column("doc_id"), batch.column("n_words")]
            columns += [pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    return spans.mapInArrow(rows, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256"]

# --- the index ------------------------------------------------------------------------


def _earlier(first: str, doc: str) -> Column:
    """The document ``first`` has a smaller id than ``doc``; a NULL id is greater than any."""
    return F.col(first).isNotNull() & (F.col(doc).isNull() | (F.col(first) < F.col(doc)))


def _in_two(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The keys that stand in documents of different ids, with the least id."""
    greatest = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    found = rows.groupBy(*keys).agg(
        F.min("doc_id").alias("_least"), F.max(greatest).alias("_greatest"), *more
    )
    return found.where("_least < _greatest").drop("_greatest")


def reference(named: DataFrame) -> DataFrame:
    """The index: _anchor, _least (first document) and _alike, of anchors in two documents."""
    alike = F.min("_content") == F.max("_content")
    return _in_two(anchors(named), ["_anchor"], alike.alias("_alike"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row.

    A word is removed if a window of ``WINDOW`` words that covers it also starts in a document
    of smaller doc_id; windows are judged on the texts as given. NULL ids are greater than any
    and equal to each other, and so are rows of one id, which never remove from each other. A
    NULL or short text loses nothing. Repeated rows give a row each; an empty table gives none.
    Other columns don't matter.
    """
    named = _named(documents)
    index = written(reference(named), "reference-index")
    blocks = anchors(named).join(index, "_anchor")
    shared = blocks.where(~F.col("_alike") | _earlier("_least", "doc_id"))
    of_doc = shared.groupBy(F.col("doc_id").alias("_of")).agg(
        F.collect_set(F.when(F.col("_alike"), F.col("_anchor"))).alias("_whole"),
        F.collect_set(F.when(~F.col("_alike"), F.col("_anchor"))).alias("_differ"),
    )
    marked = named.join(of_doc, F.col("doc_id").eqNullSafe(F.col("_of")), "left").drop("_of")
    rows = written(factored(marked), "factored", compression="gzip")

    boundary = rows.where("begin IS NOT NULL").select(
        "doc_id", "_row", "_anchor", "begin", F.posexplode("_windows").alias("_i", "_window")
    )
    keys = ["_anchor", "_window"]
    boundary = boundary.select("doc_id", "_row", *keys, (F.col("begin") + F.col("_i")).alias("_at"))
    # a table of its own, so that the join may split a window that very many texts share
    first = written(_in_two(boundary.select("doc_id", *keys), keys), "window-index")
    at_ends = boundary.join(first, keys).where(_earlier("_least", "doc_id"))
    by_row = at_ends.groupBy("_row").agg(F.collect_set("_at").alias("_at"))
    done = rows.where("begin IS NULL AND kept_sha256 IS NOT NULL").select(*NAMES)
    rest = rows.where("begin IS NULL AND kept_sha256 IS NULL").select(
        "doc_id", "_row", "n_words", "text", "_begins", "_ends"
    )
    return done.unionByName(_cleaned(rest.join(by_row, "_row", "left")))


#: The same from all windows, for ids that are set and distinct.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
  FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i)),
firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
covered AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM windows JOIN firsts USING (s), unnest(range(0, {WINDOW})) AS u(k) WHERE f < doc_id),
words AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s
  FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
