"""Class-based language model: Brown classes by exchange, class bigrams, word emissions.

p(text) = product of p(class | class before) * p(word | class), with an end token that is a
class of its own and also stands before the first word.

* Words are counted over all training texts. *Frequent* words occur ``LEAST`` times at any
  size of the input; all others fall into rare classes by a hash of their ending.
* Frequent words have numbers. All texts are written once as numbers, in a pass for each
  block of ``BLOCK`` words, so that no task holds more of them; what a block doesn't know
  stays beside the numbers for the next one. Later a word's class is one byte.
* Frequent words get their classes by exchange: each round counts, over all training texts,
  the classes before and after every frequent word, and then sweeps move each word to the
  class under which its contexts are likeliest. The counts are a table of one row per
  word; sweeps read it, get only the classes' profiles, and bring back one row per class.
  The classes of words are a table as well.
* Class bigrams are counted under the final classes. They are smoothed with the classes'
  own shares, and the words of rare classes by adding a half, with room for unseen words.

Texts are scored where their numbers are read. Only the rare words leave their document: they are
joined to the table of all counts, and what they add is summed by document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.tables import small_batches, written

#: Exchange classes, rare classes, and one for the end.
EXCHANGED, RARE = 32, 7
CLASSES = EXCHANGED + RARE + 1
END = CLASSES - 1
#: A frequent word occurs so often, as fewer times tell little of its contexts.
LEAST = 5
#: Frequent words that a task looks up at a time, about; longer ones by their digest.
BLOCK, LONG = 1 << 20, 64
#: Contexts that are counted at a time.
PENDING = 1 << 22
ROUNDS, SWEEPS = 2, 4
#: Added to each rare word's count, and the weight of a class's own share.
ADDED, PRIOR = 0.5, 20.0
#: One fold of seven, by the checksum of doc_id, is held out.
FOLDS, HELD_FOLD = 7, 2
MAX_COUNTED = 500_000

# --- tokens -------------------------------------------------------------------------


def tokens(text: bytes | None) -> list[bytes]:
    """Words between white space, A-Z in lower case; the end is not among them."""
    return (text or b"").lower().split()


def rare_class(word: bytes) -> int:
    return EXCHANGED + zlib.crc32(word[-3:]) % RARE


def _key(word: bytes) -> bytes:
    """A word, or a blank and its digest if it is long; no word holds a blank."""
    return word if len(word) <= LONG else b" " + hashlib.md5(word).digest()


class _Numbers(dict):
    """Number of a frequent word, by its key; of any other -1 - its class."""

    def __missing__(self, word: bytes) -> int:
        other = -1 - rare_class(word)
        return self.get(_key(word), other) if len(word) > LONG else other


@dataclass
class Classes:
    """The class of each frequent word, by number."""

    of_word: np.ndarray

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' tokens in a row, ends included: their numbers (the end's is -1 - END),
        their classes, and the places of the ends. A text is its words' numbers."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        ends = np.cumsum(sizes + 1) - 1
        numbers = np.full(int(ends[-1]) + 1 if len(ends) else 0, -1 - END, np.int64)
        inner = np.ones(len(numbers), bool)
        inner[ends] = False
        numbers[inner] = np.frombuffer(b"".join(texts.to_pylist()), np.int32)
        classes = -1 - numbers
        frequent = numbers >= 0
        classes[frequent] = self.of_word[numbers[frequent]]
        return numbers, classes, ends


def _held_out(doc_id: Column) -> Column:
    checksum = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    return checksum % FOLDS == HELD_FOLD


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("text").cast("binary").alias("text"))


def training_texts(documents: DataFrame) -> DataFrame:
    return _texts(documents).where(~_held_out(F.col("doc_id"))).select("text")


# --- counting -----------------------------------------------------------------------


def word_counts(training: DataFrame) -> DataFrame:
    """word, class (if it were rare) and count of every word; the end is NULL."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()

        def told() -> pa.RecordBatch:
            words, counts = list(counted), list(counted.values())
            kinds = [END if w is None else rare_class(w) for w in words]
            counted.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(kinds, pa.int32()), pa.array(counts, pa.int64())],
                ["word", "kind", "n"],
            )

        for batch in small_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                counted.update(tokens(text))
                counted[None] += 1
            if len(counted) > MAX_COUNTED:
                yield told()
        yield told()

    counted = training.mapInArrow(rows, "word binary, kind int, n bigint")
    return counted.groupBy("word", "kind").agg(F.sum("n").alias("n"))


# --- numbers ------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Counts of the frequent words by number, and the numbers of the most frequent."""

    seen: np.ndarray
    first: list[int]


def frequent(counts: DataFrame) -> DataFrame:
    """_key, _hash and n of each word that takes part in the exchange."""
    word = F.col("word")
    digest = F.concat(F.lit(b" "), F.unhex(F.md5("word")))
    return counts.where(word.isNotNull() & (F.col("n") >= LEAST)).select(
        F.when(F.octet_length("word") > LONG, digest).otherwise(word).alias("_key"),
        F.xxhash64("word").alias("_hash"),
        "n",
    )


def _looked_up(
    given: DataFrame, keys: list[bytes], seen: np.ndarray, offset: int, first: bool
) -> DataFrame:
    """``given`` with numbers for one block of words. ``given`` has ``text`` if it is the
    first one, and else what this returns: numbers, rest, known, logs and base."""
    sent = given.sparkSession.sparkContext.broadcast((keys, seen))
    made = ("text", "numbers", "rest", "known", "logs", "base")
    carried = [c for c in given.columns if c not in made]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = sent.value
        known_words = _Numbers({w: offset + i for i, w in enumerate(keys)})
        logs, base = np.log10(seen), np.log10(seen + 1)
        for batch in small_batches(batches, "text" if first else "numbers"):
            if first:
                texts = [tokens(t) for t in batch.column("text").to_pylist()]
            else:
                texts = batch.column("rest").to_pylist()
            n = len(texts)
            flat = [w for text in texts for w in text]
            found = np.fromiter(map(known_words.__getitem__, flat), np.int32, len(flat))
            sizes = np.fromiter(map(len, texts), np.int64, n)
            owner = np.repeat(np.arange(n), sizes)
            here = found >= 0
            at, of = found[here] - offset, owner[here]
            sums = [np.bincount(of, x, minlength=n) for x in (None, logs[at], base[at])]
            left = np.flatnonzero(~here)
            kept = np.bincount(owner[left], minlength=n)
            rest = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)),
                pa.array([flat[i] for i in left], pa.binary()),
            )
            if not first:
                lengths = pc.binary_length(batch.column("numbers")).to_numpy().astype(np.int64) // 4
                numbers = np.frombuffer(b"".join(batch.column("numbers").to_pylist()), np.int32).copy()
                numbers[numbers < 0] = found
                found, sizes = numbers, lengths
                before = (batch.column(c).to_numpy() for c in ("known", "logs", "base"))
                sums = [x + y for x, y in zip(sums, before, strict=True)]
            ends = np.cumsum(sizes)
            texts_of = [found[e - k : e].tobytes() for e, k in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried),
                    pa.array(texts_of, pa.binary()),
                    rest,
                    *(pa.array(x.astype(np.float64)) for x in sums),
                ],
                [*carried, *made[1:]],
            )

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name in carried]
    out = "numbers binary, rest array<binary>, known double, logs double, base double"
    return given.mapInArrow(rows, ", ".join([*kinds, out]))


def numbered(given: DataFrame, counts: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """``given`` with its ``text`` as numbers, in a table, and the frequent words.

    ``numbers`` has 4 bytes a word, of any but frequent ones -1 - its class; these are in
    ``rest``, in order. ``known`` counts the frequent ones, ``logs`` and ``base`` sum the
    logarithms of their counts and of those plus one.
    """
    words = frequent(counts)
    blocks = max(1, -(-words.count() // BLOCK))
    top = words.orderBy(F.desc("n"), "_key").limit(EXCHANGED).select("_key").collect()
    order = {bytes(r["_key"]): i for i, r in enumerate(top)}
    first, seen, out = [0] * len(order), [np.zeros(0)], given
    for block in range(blocks):
        some = words.where(F.pmod("_hash", F.lit(blocks)) == block).select("_key", "n").toArrow()
        some = some.sort_by("_key")
        keys, n = some.column("_key").to_pylist(), some.column("n").to_numpy().astype(np.float64)
        offset = sum(map(len, seen))
        for i, w in enumerate(keys):
            if w in order:
                first[order[w]] = offset + i
        out = written(_looked_up(out, keys, n, offset, block == 0), f"numbers-{block}")
        seen.append(n)
    return out, Vocabulary(np.concatenate(seen), first)


def context_counts(read: DataFrame, classes: Classes) -> DataFrame:
    """w (a frequent word's number), c and n: how often each class stands before and after
    it, where it does; those after it are ``CLASSES`` more."""
    sent = read.sparkSession.sparkContext.broadcast(classes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *pending]), return_counts=True)
            pending.clear()
            w, c = np.divmod(keys, 2 * CLASSES)
            return pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int32)) for x in (w, c, n)], ["w", "c", "n"]
            )

        for batch in small_batches(batches, "numbers"):
            numbers, found, _ = sent.value.read(batch.column("numbers"))
            at = np.flatnonzero(numbers >= 0)  # never the last: that is an end
            before = np.where(at > 0, found[at - 1], END)
            pending.append(numbers[at] * (2 * CLASSES) + before)
            pending.append(numbers[at] * (2 * CLASSES) + CLASSES + found[at + 1])
            if sum(map(len, pending)) > PENDING:
                yield told()
        yield told()

    # One shuffle by word: what a task tells is already summed.
    counted = read.mapInArrow(rows, "w int, c int, n int").repartition("w")
    cells = counted.groupBy("w", "c").agg(F.sum("n").alias("n"))
    both = cells.groupBy("w").agg(F.collect_list(F.struct("c", "n")).alias("_cells"))
    return both.select("w", F.col("_cells.c").alias("c"), F.col("_cells.n").alias("n"))


def _dense(batch: pa.RecordBatch) -> np.ndarray:
    """The context counts of a batch of words, a row of 2 * CLASSES for each."""
    counts = np.zeros((batch.num_rows, 2 * CLASSES))
    lengths = pc.list_value_length(batch.column("c")).to_numpy()
    c, n = (batch.column(x).flatten().to_numpy() for x in ("c", "n"))
    counts[np.repeat(np.arange(batch.num_rows), lengths), c] = n
    return counts


CONTEXTS = [f"c{i}" for i in range(2 * CLASSES)]


def bigram_counts(read: DataFrame, classes: Classes) -> np.ndarray:
    """How often a class follows a class; the end stands before the first word."""
    sent = read.sparkSession.sparkContext.broadcast(classes)
    following = [f"c{i}" for i in range(CLASSES)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in small_batches(batches, "numbers"):
            _, found, _ = sent.value.read(batch.column("numbers"))
            before = np.concatenate([[END], found[:-1]])
            counts += np.bincount(before * CLASSES + found, minlength=CLASSES * CLASSES)
        table = counts.reshape(CLASSES, CLASSES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CLASSES, dtype=np.int32)), *(pa.array(c.copy()) for c in table.T)],
            ["before", *following],
        )

    kinds = ", ".join(f"{c} bigint" for c in following)
    summed = read.mapInArrow(rows, f"before int, {kinds}").groupBy("before")
    counts = np.zeros((CLASSES, CLASSES), np.int64)
    for row in summed.agg(*(F.sum(c).alias(c) for c in following)).collect():
        counts[row["before"]] = row[1:]
    return counts


# --- exchange -----------------------------------------------------------------------


def _likelihoods(profiles: np.ndarray) -> np.ndarray:
    """Log probabilities of the contexts of each exchange class; both sides apart."""
    smooth = profiles + 0.1
    sides = smooth.reshape(len(profiles), 2, CLASSES)
    return np.log(sides / sides.sum(axis=2, keepdims=True)).reshape(len(profiles), -1)


def _summed(contexts: DataFrame, class_of) -> np.ndarray:
    """The profiles of the classes that ``class_of(numbers, counts)`` gives to words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((EXCHANGED, 2 * CLASSES))
        for batch in batches:
            counts = _dense(batch)
            found = class_of(batch.column("w").to_numpy(), counts)
            sums += (found == np.arange(EXCHANGED)[:, None]).astype(np.float64) @ counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(EXCHANGED, dtype=np.int32)), *(pa.array(c.astype(np.int64)) for c in sums.T)],
            ["class", *CONTEXTS],
        )

    kinds = ", ".join(f"{c} bigint" for c in CONTEXTS)
    moved = contexts.mapInArrow(rows, f"class int, {kinds}").groupBy("class")
    out = np.zeros((EXCHANGED, 2 * CLASSES))
    for row in moved.agg(*(F.sum(c).alias(c) for c in CONTEXTS)).collect():
        out[row["class"]] = row[1:]
    return out


def swept(contexts: DataFrame, profiles: np.ndarray) -> np.ndarray:
    """The classes' profiles after each word moved to its likeliest class."""
    log = _likelihoods(profiles)
    return _summed(contexts, lambda _, counts: (counts @ log.T).argmax(axis=1))


def swept_into(contexts: DataFrame, classes: Classes) -> np.ndarray:
    """The profiles of given classes."""
    sent = contexts.sparkSession.sparkContext.broadcast(classes.of_word)
    return _summed(contexts, lambda numbers, _: sent.value[numbers])


def assigned(contexts: DataFrame, profiles: np.ndarray) -> DataFrame:
    """w and class: the likeliest class of every frequent word, as a table."""
    log = _likelihoods(profiles)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (_dense(batch) @ log.T).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(found)], ["w", "class"])

    return written(contexts.mapInArrow(rows, "w int, class int"), "classes")


def exchanged(read: DataFrame, vocabulary: Vocabulary, rounds: int, sweeps: int) -> Classes:
    """Classes of the frequent words after some rounds.

    At first the most frequent words are classes of their own, all others one more; the
    classes' first profiles are those words' contexts.
    """
    first = {w: i for i, w in enumerate(vocabulary.first)}
    of_word = np.full(len(vocabulary.seen), EXCHANGED - 1, np.int8)
    for w, i in first.items():
        of_word[w] = i
    for step in range(rounds if first else 0):
        contexts = written(context_counts(read, Classes(of_word)), f"contexts-{step}")
        profiles = np.zeros((EXCHANGED, 2 * CLASSES))
        if step == 0:
            for row in contexts.where(F.col("w").isin(*first)).collect():
                profiles[first[row["w"]], row["c"]] = row["n"]
        else:
            profiles = swept_into(contexts, Classes(of_word))
        for _ in range(sweeps):
            profiles = swept(contexts, profiles)
        found = assigned(contexts, profiles).toArrow()
        of_word = of_word.copy()
        of_word[found.column("w").to_numpy()] = found.column("class").to_numpy()
    return Classes(of_word)


# --- the model ----------------------------------------------------------------------


@dataclass
class Model:
    """What scoring needs; logarithms are to base 10."""

    classes: Classes
    #: log p(class | class before)
    transitions: np.ndarray
    #: log p(word | class) of frequent words; of rare classes log(count + ADDED) less this
    emissions: np.ndarray
    rare_totals: np.ndarray
    #: log(all tokens of the class) of classes of frequent words
    class_totals: np.ndarray
    #: the base's log p of the end, and the logarithm of its divisor
    base_end: float
    base_divisor: float
    end_known: bool
    n_tokens: int

    def __getstate__(self):
        """Without the emissions: ``numbered`` has summed the counts' logarithms."""
        return {**self.__dict__, "emissions": None}


def fitted(
    read: DataFrame,
    vocabulary: Vocabulary,
    counts: DataFrame,
    rounds: int = ROUNDS,
    sweeps: int = SWEEPS,
) -> Model:
    """The model of the ``numbered`` training texts, whose ``word_counts`` are given."""
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    divisor = n + v + 1
    classes, seen = exchanged(read, vocabulary, rounds, sweeps), vocabulary.seen

    bigrams = bigram_counts(read, classes).astype(np.float64)
    share = (bigrams.sum(axis=0) + 1) / (bigrams.sum() + CLASSES)
    transitions = (bigrams + PRIOR * share) / (bigrams.sum(axis=1, keepdims=True) + PRIOR)
    of_class = np.bincount(classes.of_word, seen, minlength=CLASSES)

    rare = counts.where(F.col("word").isNotNull() & (F.col("n") < LEAST)).groupBy("kind")
    rare_totals = np.full(CLASSES, ADDED)
    for row in rare.agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        rare_totals[row["kind"]] = row["n"] + ADDED * (row["v"] + 1)
    ends = counts.where(F.col("word").isNull()).select("n").first()
    end = ends["n"] if ends else 0
    return Model(
        classes,
        np.log10(transitions),
        np.log10(seen / of_class[classes.of_word]),
        np.log10(rare_totals),
        np.log10(np.maximum(of_class, 1)),
        float(np.log10((end + 1) / divisor)),
        float(np.log10(divisor)),
        end > 0,
        int(n),
    )


def trained(training: DataFrame, counts: DataFrame, rounds: int = ROUNDS, sweeps: int = SWEEPS) -> Model:
    """The model of the training texts, whose ``word_counts`` are given as a table."""
    read, vocabulary = numbered(training, counts)
    return fitted(read, vocabulary, counts, rounds, sweeps)


SUMS = ("n_tokens", "n_known", "base_score", "score")
#: Row keys hold a blank, which no word does.
_ROW_KEY = b" "


def _read(read: DataFrame, model: Model) -> DataFrame:
    """A row for each ``numbered`` document, and one for each of its rare words.

    ``_word`` is what to join the counts on. A document's own row has a key that spreads
    them and matches no word; ``times`` is 0 there.
    """
    sent = read.sparkSession.sparkContext.broadcast(model)
    kind = read.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in small_batches(batches, "numbers", 1 << 20):
            numbers, found, ends = m.classes.read(batch.column("numbers"))
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
            before = np.concatenate([[END], found[:-1]])
            frequent = numbers >= 0
            score = m.transitions[before, found]
            score[frequent] -= m.class_totals[found[frequent]]
            n = len(ends)
            known, logs, base = (batch.column(c).to_numpy() for c in ("known", "logs", "base"))
            sums = [
                known + m.end_known,
                base - known * m.base_divisor + m.base_end,
                np.bincount(owner, score, minlength=n) + logs,
            ]
            rare = Counter(
                (i, w) for i, text in enumerate(batch.column("rest").to_pylist()) for w in text
            )
            of = np.fromiter((i for i, _ in rare), np.int64, len(rare))
            keys = batch.column("_hash").to_pylist()
            both = np.concatenate([np.arange(n), of])
            zeros = np.zeros(len(rare))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(both)),
                    batch.column("_hash").take(pa.array(both)),
                    pa.array(
                        [_ROW_KEY + str(k).encode() for k in keys] + [w for _, w in rare],
                        pa.binary(),
                    ),
                    pa.array([0] * n + list(rare.values()), pa.int32()),
                    pa.array([END] * n + [rare_class(w) for _, w in rare], pa.int32()),
                    pa.array(np.concatenate([np.diff(ends, prepend=-1), zeros.astype(np.int64)])),
                    *(pa.array(np.concatenate([s, zeros])) for s in sums),
                ],
                ["doc_id", "_hash", "_word", "times", "kind", "n_tokens", "known", "base", "model"],
            )

    given = read.select("doc_id", "_hash", "numbers", "rest", "known", "logs", "base")
    return given.mapInArrow(
        rows,
        f"doc_id {kind}, _hash bigint, _word binary, times int, kind int,"
        " n_tokens bigint, known double, base double, model double",
    )


def scores(numbers: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    A NULL text is an empty one, which has one token, the end. Of repeated rows each gets
    its row. A NULL doc_id is in the training folds. An empty table gives no rows; without
    training texts every word is unknown. Other columns don't matter.
    """
    read = _read(numbers, model)
    of_word = counts.where(F.col("word").isNotNull()).select("word", "n")
    joined = read.join(of_word, F.col("_word") == F.col("word"), "left")
    times, n = F.col("times"), F.coalesce("n", F.lit(0))
    rare_total = F.get(F.array(*map(F.lit, model.rare_totals.tolist())), "kind")
    rare = F.when(times > 0, times).otherwise(0)
    added = joined.groupBy("doc_id", "_hash").agg(
        F.count_if(times == 0).alias("_copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(n > 0, rare).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + rare * (F.log10(n + 1) - model.base_divisor)).alias("base_score"),
        F.sum(F.col("model") + rare * (F.log10(n + ADDED) - rare_total)).alias("score"),
    )
    each = added.select(
        "doc_id",
        _held_out(F.col("doc_id")).alias("held_out"),
        *((F.col(c) / F.col("_copies")).alias(c) for c in SUMS),
        F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"),
    )
    return each.select(
        "doc_id",
        "held_out",
        F.round("n_tokens").cast("bigint").alias("n_tokens"),
        F.round("n_known").cast("bigint").alias("n_known"),
        F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def scored(documents: DataFrame) -> DataFrame:
    """Learn from the training folds of ``documents`` and score all of them."""
    counts = written(word_counts(training_texts(documents)), "word-counts")
    given = _texts(documents).withColumn("_hash", F.xxhash64("text"))
    read, vocabulary = numbered(given, counts)
    model = fitted(read.where(~_held_out(F.col("doc_id"))), vocabulary, counts)
    return scores(read, model, counts)
