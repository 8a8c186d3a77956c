"""Byte-level BPE encoding and decoding: ranked merges as a fold over arrays.

Three narrow steps, no shuffle:

1. an Arrow pass splits each text with the pre-tokenizer pattern, cuts words where no token
   of the vocabulary could span, and numbers the parts. A part that its task has not met
   before travels along as an array of byte tokens with their pairs' ranks;
2. Spark's higher-order functions encode those distinct parts: ``aggregate`` folds merges
   over the array, each step replacing the adjacent pair of lowest rank. The ranks are a
   perfect hash, so that a lookup reads one element of each of two arrays; they come by a
   scalar subquery, so that no plan and no description of one holds them;
3. an Arrow pass, in the same task and order, turns the parts' numbers into token ids.

Decoding concatenates the tokens' bytes, with Spark functions alone.

A task's dictionaries start anew after ``MAX_WORDS`` words or parts, on both sides at the same
row, so that their memory is bounded. Lost tasks start over at their first row.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.llm.tables import small_batches

#: Distinct words a task remembers before it starts its dictionary anew.
MAX_WORDS = 1 << 20
#: Longer words (a run of one character class without a break) are merged with a heap
#: before, as the fold is quadratic in a word.
FOLD_BYTES = 256
#: Words of which the last pass makes token ids at once, or one row.
PART_WORDS = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: base64 token and rank per line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank, which is also the new token's id, of each mergeable pair of token ids."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left, right] = rank
    return pairs


# --- the rank map and the fold ----------------------------------------------------------

_BUCKETS, _SPREAD = 65_521, 8_191
#: Where the items of tokens that begin a pair start, and the bits of an item that are the id.
_RANKED, _ID = -1 << 63, (1 << 32) - 1


def id_bits(ranks: dict[bytes, int]) -> int:
    """Half the bits of an integer that holds a token id and a rank: an int's or a bigint's."""
    return 16 if max(ranks.values(), default=0) < 1 << 16 else 32


def rank_map(pairs: dict[tuple[int, int], int], bits: int) -> tuple[pa.Array, pa.Array]:
    """The ranks of pairs as a perfect hash of two arrays, ``shifts`` and ``entries``.

    A pair's entry is at ``shifts[(left * 8191 + right) % 65521] + left``. It holds left and
    rank, ``bits`` each, with the sign bit turned, so that ``entry ^ left << bits`` is
    ``rank - limit``, below all that the entries of other pairs give. No two buckets share a
    shift, which is why left alone tells an entry's pair. Other places are NULL.
    """
    buckets: dict[int, list[int]] = {}
    for left, right in pairs:
        buckets.setdefault((left * _SPREAD + right) % _BUCKETS, []).append(left)
    shifts, taken, owners = {}, set(), {}
    for bucket in sorted(buckets, key=lambda b: (-len(buckets[b]), b)):
        shift = 4 * bucket
        while shift in taken or not owners.keys().isdisjoint(shift + x for x in buckets[bucket]):
            shift += 1
        taken.add(shift)
        shifts[bucket] = shift
        owners.update((shift + x, x) for x in buckets[bucket])
    entries: list[int | None] = [None] * (max(owners, default=-1) + 1)
    for (left, right), rank in pairs.items():
        place = shifts[(left * _SPREAD + right) % _BUCKETS] + left
        value = (left << bits | rank) ^ 1 << 2 * bits - 1
        entries[place] = value - (value >> 2 * bits - 1 << 2 * bits)
    return (
        pa.array([shifts.get(b) for b in range(_BUCKETS)], pa.int32()),
        pa.array(entries, pa.int32() if bits == 16 else pa.int64()),
    )


def _held(spark: SparkSession, **arrays: pa.Array) -> Column:
    """Arrays as one value that the plan refers to. A literal of so many numbers would be boxed
    and printed in every description of the plan, which the driver keeps."""
    row = pa.table({k: pa.ListArray.from_arrays([0, len(v)], v) for k, v in arrays.items()})
    return spark.createDataFrame(row).select(F.struct("*")).scalar()


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(items: Column, shifts: Column, entries: Column, bits: int) -> Column:
    """The items of one word's tokens, from those of its byte tokens.

    An item is a token's id and, above its 32 bits, the rank of the pair that the token begins,
    so that the least item is the pair to merge next: an item of rank r is at
    ``_RANKED + (r << 32)`` or after, those that begin no pair are after all of these. Each step
    of the fold replaces the pair of lowest rank, the leftmost among equals, by its token, and
    looks up the two pairs that the token is in.
    """
    none, gone = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    beyond = F.lit(_RANKED + (1 << 32 + min(bits, 31))).cast("bigint")

    def item(left: Column, right: Column) -> Column:
        bucket = (left * F.lit(_SPREAD) + right) % F.lit(_BUCKETS)
        found = F.get(entries, F.get(shifts, bucket) + left).bitwiseXOR(F.shiftleft(left, bits))
        # Only the pair's own entry leaves one of the lowest 2**bits numbers.
        if bits == 16:
            rank = F.coalesce(F.shiftleft(found, 32), none)
        else:
            own = found < F.lit(_RANKED + (1 << bits))
            rank = F.when(own, F.shiftleft(found, 32).bitwiseXOR(F.lit(_RANKED))).otherwise(none)
        return rank.bitwiseOR(left)

    def token(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_ID))

    def step(now: Column, _: Column) -> Column:
        lowest = F.array_min(now)

        def merged(at: Column) -> Column:
            """The pair's left item, the ``at``-th, becomes the new one, its right item goes."""

            def marked(new: Column) -> Column:
                return F.transform(
                    now,
                    lambda x, i: F.when((i > at) | (i < at - 2), x)
                    .when(i == at, gone)
                    .when(i == at - 1, item(new, token(F.get(now, at + 1))))
                    .otherwise(item(token(x), new)),
                )

            new = F.shiftright(lowest.bitwiseXOR(F.lit(_RANKED)), 32)
            return F.array_remove(_bind(new, marked), gone)

        found = F.array_position(now, lowest).cast("int")
        return F.when(lowest < beyond, _bind(found, merged)).otherwise(now)

    # A word of n bytes has n - 1 merges at most. Longer ones come merged.
    steps = F.slice(items, F.lit(2), F.size(items))
    return F.when(
        (F.size(items) > 1) & (F.size(items) <= FOLD_BYTES), F.aggregate(steps, items, step)
    ).otherwise(items)


def merge_long(tokens: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges for a word beyond ``FOLD_BYTES``, by a heap over a linked list."""
    ids: list[int | None] = list(tokens)
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [
        (pairs[p], i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in pairs
    ]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j >= len(ids) or ids[i] is None or pairs.get((ids[i], ids[j])) != rank:
            continue
        ids[i], ids[j], after[i] = rank, None, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
            if (found := pairs.get((rank, ids[after[i]]))) is not None:
                heapq.heappush(heap, (found, i))
        if before[i] >= 0 and (found := pairs.get((ids[before[i]], rank))) is not None:
            heapq.heappush(heap, (found, before[i]))
    return [x for x in ids if x is not None]


# --- the two Arrow passes -----------------------------------------------------------


class _Numbers(dict):
    """Numbers of words in order of their first appearance; ``told`` are the new ones."""

    def __init__(self):
        self.told: list = []

    def __missing__(self, word: str | bytes) -> int:
        self.told.append(word)
        n = self[word] = len(self)
        return n


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, and where each word ends."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths)


class _Cutter:
    """Words to parts, and parts to the items of their byte tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, {}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        tokens, ends = _flat(list(ranks))
        inside = np.ones(len(tokens), bool)
        inside[ends - 1] = False
        before = np.flatnonzero(inside)
        self.adjacent = np.zeros((256, 256), bool)
        self.adjacent[tokens[before], tokens[before + 1]] = True
        self.rank = np.zeros((256, 256), np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.rank[token[0], token[1]] = _RANKED + (rank << 32)

    def parts(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The words' parts, and how many each word has. A word is cut between two bytes that
        are adjacent in no token, as no merge can join them."""
        given = [word.encode() for word in words]
        tokens, ends = _flat(given)
        last = np.ones(len(tokens), bool)
        last[:-1] = ~self.adjacent[tokens[:-1], tokens[1:]]
        last[ends[ends > 0] - 1] = True
        stops = np.flatnonzero(last) + 1
        joined, at = b"".join(given), [0, *stops.tolist()]
        counts = np.diff(np.searchsorted(stops, ends, "right"), prepend=0)
        return [joined[i:j] for i, j in zip(at, at[1:], strict=False)], counts

    def items(self, parts: list[bytes]) -> pa.Array:
        """What ``fold_merges`` takes for each part; of long parts, what the merges give."""
        tokens, ends = _flat(parts)
        items = np.zeros(len(tokens), np.int64)
        items[:-1] = self.rank[tokens[:-1], tokens[1:]]
        items[ends - 1] = 0
        items |= self.of_byte[tokens]
        lengths = np.diff(ends, prepend=0)
        if len(long := np.flatnonzero(lengths > FOLD_BYTES)):
            self.pairs = self.pairs or pair_ranks(self.ranks)
            split = np.split(items, ends[:-1])
            for i in long:
                merged = merge_long((split[i] & _ID).tolist(), self.pairs)
                split[i], lengths[i] = np.array(merged, np.int64), len(merged)
            items = np.concatenate(split)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(items))


class _Dictionary:
    """Token ids by word number, in two flat arrays that grow."""

    def __init__(self):
        self.ids, self.starts = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.words = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        used, words = self.starts[self.words], self.words + len(lengths)
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (used + len(ids)))
        if words + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (words + 1))
        self.ids[used : used + len(ids)] = ids
        self.starts[self.words + 1 : words + 1] = used + np.cumsum(lengths)
        self.words = words

    def look(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each word has."""
        first = self.starts[numbers]
        lengths = self.starts[numbers + 1] - first
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(first - ends + lengths, lengths) + np.arange(total)], lengths


def _number_words(text: str, pattern: str, ranks: dict[bytes, int], max_words: int):
    """Replace the text by the numbers of its words' parts; new parts come as items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cutter = regex.compile(pattern).findall, _Cutter(ranks)
        words, parts, known = _Numbers(), _Numbers(), _Dictionary()
        for batch in small_batches(batches, text, 1 << 20):
            found, told, ends, fresh = [], [], [0], []
            full = len(parts) >= max_words
            for value in batch.column(text).to_pylist():
                given = find(value or "")
                fresh.append(full or len(words) >= max_words)
                if fresh[-1]:
                    words, full = _Numbers(), False
                found.append(np.fromiter(map(words.__getitem__, given), np.int32, len(given)))
                told += words.told
                ends.append(len(told))
                words.told = []
            # The rows of one dictionary at once.
            numbers, sizes, news, new_parts = [], [], [], []
            begins = sorted({0, *np.flatnonzero(fresh).tolist()})
            for begin, end in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                if fresh[begin]:
                    parts, known = _Numbers(), _Dictionary()
                pieces, counts = cutter.parts(told[ends[begin] : ends[end]])
                met = len(parts)
                of_words = np.fromiter(map(parts.__getitem__, pieces), np.int32, len(pieces))
                known.add(of_words, counts)
                of_texts, lengths = known.look(np.concatenate(found[begin:end]))
                numbers.append(of_texts)
                at = np.cumsum([0, *map(len, found[begin:end])])
                sizes.append(np.diff(np.concatenate([[0], np.cumsum(lengths)])[at]))
                # How many parts are known after each of the words' parts, and after each row.
                reached = np.maximum.accumulate(np.concatenate([[met], of_words + 1]))
                at = np.array(ends[begin : end + 1]) - ends[begin]
                news.append(np.diff(reached[np.concatenate([[0], np.cumsum(counts)])[at]]))
                new_parts += parts.told
                parts.told = []
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    _lists(sizes, pa.array(np.concatenate(numbers))),
                    _lists(news, cutter.items(new_parts)),
                    pa.array(fresh, pa.bool_()),
                ],
                [*names, "_words", "_new", "_fresh"],
            )

    return rows


def _lists(sizes: list[np.ndarray], values: pa.Array) -> pa.Array:
    """Lists of these sizes, one after another."""
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _assemble(keep: list[str], out: str):
    """Word numbers and encoded new words to the token ids of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Dictionary()
        for batch in batches:
            fresh = batch.column("_fresh").to_numpy(zero_copy_only=False)
            begins = np.diff(batch.column("_words").offsets.to_numpy()).cumsum() // PART_WORDS
            cut = np.flatnonzero(fresh[1:] | (np.diff(begins) > 0)) + 1
            for begin, end in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if fresh[begin]:
                    known = _Dictionary()
                encoded = part.column("_encoded").flatten()
                known.add(
                    # An item's low 32 bits are its id.
                    encoded.flatten().to_numpy(zero_copy_only=False).astype(np.int32),
                    np.diff(encoded.offsets.to_numpy()) if len(encoded) else np.empty(0, np.int64),
                )
                words = part.column("_words")
                ids, lengths = known.look(words.flatten().to_numpy(zero_copy_only=False))
                ends = np.concatenate([[0], np.cumsum(lengths)])
                offsets = words.offsets.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(n) for n in keep),
                        pa.ListArray.from_arrays(
                            pa.array(ends[offsets - offsets[0]], pa.int32()), pa.array(ids)
                        ),
                    ],
                    [*keep, out],
                )

    return rows


# --- operators ----------------------------------------------------------------------


def encode(
    documents: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    out: str = "ids",
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """The columns ``keep`` and the token ids ``out`` of every row's whole text.

    A NULL text is an empty one, and has no ids. Repeated rows stay, each encoded. Other
    columns of ``documents`` don't matter, whatever their names; ``keep`` may not hold
    ``out``, ``text`` or a name that starts with ``_``.
    """
    keep = list(keep)
    if any(name in (out, text) or name.startswith("_") for name in keep):
        raise ValueError(f"keep has a reserved name: {keep}")
    fields = documents.select(*keep).schema.simpleString().removeprefix("struct<")[:-1]
    fields = fields + ", " if fields else ""
    bits = id_bits(ranks)
    shifts, entries = rank_map(pair_ranks(ranks), bits)
    numbered = documents.select(*keep, text).mapInArrow(
        _number_words(text, pattern, ranks, max_words),
        f"{fields}_words array<int>, _new array<array<bigint>>, _fresh boolean",
    )

    def all_words(held: Column) -> Column:
        """Each array is bound by itself, as a field would be made anew at every lookup."""

        def folded(shifts: Column, entries: Column) -> Column:
            return F.transform("_new", lambda word: fold_merges(word, shifts, entries, bits))

        return _bind(held["shifts"], lambda s: _bind(held["entries"], lambda e: folded(s, e)))

    # A subquery may not be written within a lambda; as it is used once, the two selections
    # become one, and no row carries the arrays.
    maps = _held(documents.sparkSession, shifts=shifts, entries=entries).alias("_held")
    encoded = numbered.select("*", maps).select(
        *keep, "_words", _bind(F.col("_held"), all_words).alias("_encoded"), "_fresh"
    )
    return encoded.mapInArrow(_assemble(keep, out), f"{fields}{out} array<int>")


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that token ids stand for: the tokens' bytes, concatenated."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def digests(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded bytes, for ``ids``."""
    return encoded.select(
        *(c for c in encoded.columns if c != ids),
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col(ids), ranks), 256).alias("decoded_sha256"),
    )
