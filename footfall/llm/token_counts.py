"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer is compiled into a cascade of two deterministic transducers:

* The *splitter* reads character classes and marks where the pre-tokenizer's words begin. It
  has nine states. A stream of texts is cut into chunks of equal length; each chunk is read
  from all nine states at once, which gives its state map, and the maps compose in a
  parallel prefix scan to the state in which each chunk is entered. A second reading then
  marks the words. Neither reading depends on where texts begin or on how long they are.
* The *merge transducer* reads the bytes of a word; its transitions are annotated with the
  change of the number of emitted tokens. It rests on two facts: the tokens of a word are
  those of a prefix followed by the last token, and a sequence of tokens is the encoding of
  its bytes if each adjacent pair is. A state holds, for each position from which a token may
  still end later, the last token there and the count so far, relative to the present one.
  Positions further back than the longest token can't matter, so there are finitely many
  states. They are compiled when they are first reached, and kept by the Python worker.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footfall.llm.tables import small_batches

#: Characters of a chunk, and of a block of chunks that is held as arrays.
CHUNK, BLOCK = 128, 1 << 22
#: The worker forgets compiled states, and counts of words, beyond so many.
MAX_STATES, MAX_WORDS = 500_000, 1_000_000

# --- the splitter -------------------------------------------------------------------

# Character classes. The letters of the contractions 's 't 'm 'd 're 've 'll are apart.
SPACE, WHITE, LETTER, STMD, RV, E, L, NUMBER, APOSTROPHE, OTHER, END = range(11)
CLASSES = 11
# States: what the word that the last character belongs to may go on with.
FRESH, LETTERS, NUMBERS, OTHERS, AFTER_SPACE, AFTER_WHITE, QUOTE, QUOTE_RV, QUOTE_L = range(9)
STATES = 9
# Marks: a word begins at this character, or at the one before.
HERE, BEFORE = 1, 2
#: Unicode's property White_Space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000,
)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point."""
    classes = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            classes[point] = LETTER
        elif kind == "N":
            classes[point] = NUMBER
    classes[list(WHITE_SPACE)] = WHITE
    classes[ord(" ")], classes[ord("'")] = SPACE, APOSTROPHE
    for letters, kind in (("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        classes[[ord(x) for x in letters]] = kind
    return classes


def _split(state: int, kind: int) -> tuple[int, int]:
    """The splitter's next state and its marks."""
    letter = kind in (LETTER, STMD, RV, E, L)
    if kind == END:
        return FRESH, HERE | (BEFORE if state in (QUOTE_RV, QUOTE_L) else 0)
    if state in (QUOTE_RV, QUOTE_L):
        if kind == (E if state == QUOTE_RV else L):
            return FRESH, 0  # 're 've 'll
        # No contraction: the apostrophe is a word, and its letter begins the next.
        following, marks = _split(LETTERS, kind)
        return following, marks | BEFORE
    if state == AFTER_SPACE and kind not in (SPACE, WHITE):
        # The last space of a run goes with what follows.
        return LETTERS if letter else NUMBERS if kind == NUMBER else OTHERS, BEFORE
    if state == AFTER_WHITE and kind not in (SPACE, WHITE):
        following, _ = _split(FRESH, kind)
        return following, HERE | BEFORE
    goes_on = (
        (state == LETTERS and letter)
        or (state == NUMBERS and kind == NUMBER)
        or (state in (OTHERS, QUOTE) and kind in (OTHER, APOSTROPHE))
        or (state in (AFTER_SPACE, AFTER_WHITE) and kind in (SPACE, WHITE))
    )
    if goes_on and state in (LETTERS, NUMBERS):
        return state, 0
    if goes_on and state in (OTHERS, QUOTE):
        return OTHERS, 0
    if state == QUOTE and kind == STMD:
        return FRESH, 0
    if state == QUOTE and kind in (RV, L):
        return QUOTE_RV if kind == RV else QUOTE_L, 0
    begun = {SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, NUMBER: NUMBERS, APOSTROPHE: QUOTE}
    following = begun.get(kind, LETTERS if letter else OTHERS)
    return following, 0 if goes_on else HERE


#: By state * CLASSES + class: the next state times CLASSES, and the marks.
_STEPS = [_split(s, c) for s in range(STATES) for c in range(CLASSES)]
_NEXT = np.array([s * CLASSES for s, _ in _STEPS], np.intp)
_MARKS = np.array([m for _, m in _STEPS], np.uint8)


# Two characters at a time: by state * PAIRS + class * CLASSES + class.
PAIRS = CLASSES * CLASSES
_NEXT_PAIR = _NEXT[(_NEXT[:, None] + np.arange(CLASSES)).reshape(-1)] // CLASSES * PAIRS


def state_maps(chunks: np.ndarray) -> np.ndarray:
    """For each chunk (a row of classes) the state it ends in, by the state it is entered in."""
    maps = np.tile(np.arange(STATES, dtype=np.intp) * PAIRS, (len(chunks), 1))
    pairs = chunks[:, ::2] * np.uint8(CLASSES) + chunks[:, 1::2]
    for column in pairs.T:
        maps += column[:, None]
        maps = _NEXT_PAIR[maps]
    return maps // PAIRS


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps: after step k, row i spans 2**k chunks up to i."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps


def word_starts(classes: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Where words begin in a block entered in ``state`` (-1: just before the block), and the
    state at its end."""
    n = len(classes)
    whole = n // CHUNK
    chunks = classes[: whole * CHUNK].reshape(whole, CHUNK)
    marks = np.zeros(n + 1, np.uint8)
    if whole:
        scan = composed(state_maps(chunks))
        states = np.concatenate([[state], scan[:-1, state]]) * CLASSES
        marked = np.empty((CHUNK, whole), np.uint8)
        for i, column in enumerate(np.ascontiguousarray(chunks.T)):
            at = states + column
            marked[i], states = _MARKS[at], _NEXT[at]
        marks[: whole * CHUNK] = marked.T.reshape(-1)
        state = int(scan[-1, state])
    for i in range(whole * CHUNK, n):
        state, marks[i] = _STEPS[state * CLASSES + classes[i]]
    begins = np.zeros(n + 1, bool)  # begins[0] is the character before the block
    begins[1:] = marks[:-1] & HERE
    begins[:-1] |= (marks[:-1] & BEFORE) > 0
    return np.flatnonzero(begins) - 1, state


# --- the merge transducer -----------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies (fixed by the format)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTransducer:
    """Counts the tokens of a word; states and transitions are compiled on demand.

    Tokens are numbered, bytes first and then merges by rank. A state is a flat tuple of
    cuts, three numbers each: the trie node of the bytes since the cut, the token before
    it (-1 at the word's begin), and the count there relative to the present count.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        numbers = {bytes([b]): b for b in range(256)}
        #: parts of a merged token, and ranks of pairs: the merged token's number
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.merged: dict[int, int] = {}
        for left, right in merges:
            if left + right in numbers:
                raise ValueError("two merges make the same token")
            a, b = numbers[left], numbers[right]
            self.merged[a << 32 | b] = numbers[left + right] = len(numbers)
            self.parts.append((a, b))
        #: trie of the tokens: (node << 8 | byte) to child; the token that ends at a node
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [-1], [False]
        for token, number in numbers.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = self.child[key]
            self.token_at[node] = number
        self.follows: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple[int, ...]] = [(0, -1, 0)]
        self.numbers = {(0, -1, 0): 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.follows.clear()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What lies at a token's left (0) or right (1) end while it is being merged: each
        part with the token it is merged into, the last one first."""
        edge, into = [], len(self.parts)
        while True:
            edge.append((token, into))
            parts = self.parts[token]
            if parts is None:
                return edge
            token, into = parts[side], token

    def may_follow(self, last: int, token: int) -> bool:
        """Whether two tokens are the encoding of their bytes.

        They are, unless some part at the end of the one and some part at the begin of the
        other merge before either merges within its token; of equal ranks, the left goes
        first. As a part lasts from its own merge to the next, only pairs that overlap in
        time are looked at.
        """
        if last < 0:
            return True
        key = last << 32 | token
        known = self.follows.get(key)
        if known is None:
            known = True
            lefts, rights = self._edge(last, 1), self._edge(token, 0)
            i = j = 0
            while i < len(lefts) and j < len(rights):
                (left, left_into), (right, right_into) = lefts[i], rights[j]
                rank = self.merged.get(left << 32 | right)
                if rank is not None and rank < left_into and rank <= right_into:
                    known = False
                    break
                # Go back in time to before the later of the two was made.
                if left >= right:
                    i += 1
                else:
                    j += 1
            self.follows[key] = known
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and by how much the number of tokens grows."""
        cuts, reached = self.states[state], []
        token = count = -1
        for i in range(0, len(cuts), 3):
            node = self.child.get(cuts[i] << 8 | byte)
            if node is None:
                continue
            reached.append((node, cuts[i + 1], cuts[i + 2]))
            ends = self.token_at[node]
            if token < 0 and ends >= 0 and self.may_follow(cuts[i + 1], ends):
                token, count = ends, cuts[i + 2] + 1
        key: tuple[int, ...] = ()
        for node, last, n in reached:
            if self.inner[node]:
                key += (node, last, n - count)
        key += (0, token, 0)
        following = self.numbers.setdefault(key, len(self.states))
        if following == len(self.states):
            self.states.append(key)
        step = self.steps[state << 8 | byte] = following, count
        return step

    def count(self, word: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self._clear()
        state = total = 0
        steps = self.steps
        for byte in word:
            step = steps.get(state << 8 | byte)
            state, more = step if step is not None else self._compile(state, byte)
            total += more
        return total


class _Counts(dict):
    """The number of tokens of a word, from the transducer when it is first asked for."""

    def __init__(self, transducer: MergeTransducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        n = self[word] = self.transducer.count(word.encode())
        return n


@lru_cache(maxsize=2)
def _machine(tokenizer: str) -> tuple[_Counts, re.Pattern | None]:
    """The compiled tokenizer and the pattern of its added tokens."""
    spec = json.loads(tokenizer)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
    if model["type"] != "BPE" or spec["normalizer"] or not plain or pre["add_prefix_space"]:
        raise ValueError("not a byte-level BPE tokenizer without normalizer")
    added = spec["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in what is around them")
    letters = _byte_letters()
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    merges = [(bytes(map(letters.get, a)), bytes(map(letters.get, b))) for a, b in pairs]
    contents = sorted((t["content"] for t in added), key=len, reverse=True)
    special = re.compile("|".join(map(re.escape, contents))) if contents else None
    return _Counts(MergeTransducer(merges)), special


def count_texts(texts: list[str], tokenizer: str) -> np.ndarray:
    """The number of tokens of each text."""
    counts, special = _machine(tokenizer)
    parts, owners, total = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        pieces = special.split(text) if special else [text]
        total[i] = len(pieces) - 1
        parts += pieces
        owners += [i] * len(pieces)
    stream = "\n".join([*parts, ""])  # one character after each part, which stands for its end
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) - 1
    table, state, found = character_classes(), FRESH, []
    for begin in range(0, len(stream), BLOCK):
        block = stream[begin : begin + BLOCK].encode("utf-32-le")
        classes = table[np.frombuffer(block, np.uint32)]
        low, high = np.searchsorted(ends, [begin, begin + BLOCK])
        classes[ends[low:high] - begin] = END
        starts, state = word_starts(classes, state)
        starts += begin
        again = found and len(starts) and len(found[-1]) and starts[0] == found[-1][-1]
        found.append(starts[1:] if again else starts)
    starts = np.concatenate(found) if found else np.empty(0, np.int64)
    bounds = starts.tolist()
    # The last start is the end of the last part; a start at an end is no word.
    words = map(stream.__getitem__, map(slice, bounds, bounds[1:]))
    n_tokens = np.fromiter(map(counts.__getitem__, words), np.int64, max(0, len(bounds) - 1))
    part = np.searchsorted(ends, starts[:-1])
    word = ends[part] != starts[:-1]
    of_part = np.bincount(part[word], n_tokens[word], minlength=len(parts))
    return total + np.bincount(owners, of_part, minlength=len(texts)).astype(np.int64)


# --- operator -----------------------------------------------------------------------


def token_counts(
    documents: DataFrame,
    tokenizer: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    limit: int = 512,
) -> DataFrame:
    """``keep``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every whole text.

    ``tokenizer`` is the content of a tokenizer.json of byte-level BPE. Special strings inside
    a text count as the library does by default: as one token. A NULL text counts as an
    empty one, with 0 bytes and tokens; repeated rows each get their row. Texts may have any
    length: a block of characters is held as arrays at a time. Other columns don't matter;
    ``keep`` may not hold the result's names.
    """
    keep = list(keep)
    if {"n_bytes", "n_tokens", "over_limit", text} & set(keep):
        raise ValueError(f"keep has a reserved name: {keep}")
    _machine(tokenizer)  # a tokenizer of another kind fails here, not in a task
    content = documents.sparkSession.sparkContext.broadcast(tokenizer)
    fields = documents.select(*keep).schema.simpleString().removeprefix("struct<")[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            totals = count_texts(texts, content.value)
            columns = [batch.column(n) for n in (*keep, "_bytes")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals)], [*keep, "n_bytes", "n_tokens"]
            )

    sized = documents.select(
        *keep, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("_bytes")
    )
    comma = ", " if fields else ""
    counted = sized.mapInArrow(rows, f"{fields}{comma}n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
