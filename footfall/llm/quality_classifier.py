"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A grade is 0 (toxic), 1 (poor) or 2 (good). All grades share one weight per hashed
feature of the text; ordered thresholds cut the text's score into grades:
P(grade >= k) = sigmoid(score - threshold_k). The expected grade ranks documents, and the
tail probability P(grade >= 2) selects them.

The model is fitted on at most ``SAMPLE`` rated documents, those whose ids have the lowest
hashes, and is then applied to every row in one narrow pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footfall.llm.tables import small_batches, written

#: Rated documents to fit on, at most. Their texts are taken whole, as in scoring.
SAMPLE = 12_000
#: Numbers of hashed words, and after them of hashed shapes.
BUCKETS, SHAPES = 1 << 18, 1 << 10
#: A word gets a weight if it is in so many documents of the sample, and in at most this
#: share of them: what is in most texts of a language would only measure length.
MIN_DOCUMENTS, MAX_SHARE = 3, 0.1
#: The rate of the weights and of the thresholds, and the pull of each weight towards 0.
STEPS, BATCH, RATE, PULL = 1_500, 64, 2.0, 20.0
#: Documents stay whose probability of grade 2 is so high.
KEEP_FROM = 0.3
MAX_WORDS = 1 << 19

GRADES = 3
_WORD = re.compile(r"[^\W\d_]+")
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]=~^]")


class _Hashes(dict):
    """Feature number of a word; forgets all beyond ``MAX_WORDS``."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        n = self[word] = zlib.crc32(word.encode()) % BUCKETS
        return n


def _shape(text: str, words: list[str], distinct: int) -> list[str]:
    """How the text looks, in coarse steps."""
    n, lines = max(1, len(text)), [x for x in text.split("\n") if x.strip()]

    def step(name: str, share: float) -> str:
        return f"{name}={min(9, int(share * 20))}"

    return [
        step("<upper>", sum(map(str.isupper, text)) / n),
        step("<symbol>", len(_SYMBOL.findall(text)) / n),
        step("<repeat>", 1 - distinct / max(1, len(words))),
        step("<lines>", 1 - len(set(lines)) / max(1, len(lines))),
        step("<digit>", sum(map(str.isdigit, text)) / n),
        f"<words>={min(12, len(words).bit_length())}",
    ]


def features(text: str, hashes: dict[str, int]) -> np.ndarray:
    """Distinct feature numbers of a text: its words, without case, and its shape."""
    words = _WORD.findall(text.lower())
    distinct = set(words)
    found = {hashes[w] for w in distinct}
    for shape in _shape(text, words, len(distinct)):
        found.add(BUCKETS + zlib.crc32(shape.encode()) % SHAPES)
    return np.fromiter(sorted(found), np.int32, len(found))


@dataclass(frozen=True)
class Model:
    """Weights by feature number, and the ordered thresholds of grades 1 and 2."""

    weights: np.ndarray
    thresholds: tuple[float, float]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1) and P(grade >= 2) by row."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - np.array(self.thresholds), -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, seed: int = 0) -> Model:
    """Maximum likelihood with an L1 penalty, by follow-the-regularized-leader (FTRL).

    The penalty leaves most words without weight, so that a text's score doesn't grow with
    its length; a text without any telling feature gets the thresholds' own probabilities.
    Without any rating, every grade is held for 2.
    """
    weights = np.zeros(BUCKETS + SHAPES)
    if not len(rows):
        return Model(weights, (-60.0, -60.0))
    counts = np.bincount(np.concatenate(rows), minlength=len(weights))
    used = counts >= MIN_DOCUMENTS
    used[:BUCKETS] &= counts[:BUCKETS] <= MAX_SHARE * len(rows)
    rows = [r[used[r]] for r in rows]
    # Thresholds start at the shares of the grades, with half a document more in each.
    share = [(np.sum(grades < k) + 0.5 * k) / (len(grades) + 1.5) for k in (1, 2)]
    low, high = (np.log(s / (1 - s)) for s in share)
    log_gap, t_squares = np.log(max(0.05, high - low)), np.full(2, 1.0)
    pulled, squares = np.zeros_like(weights), np.zeros_like(weights)
    order = np.random.default_rng(seed)
    for _ in range(-(-STEPS * BATCH // len(rows))):
        places = order.permutation(len(rows))
        for begin in range(0, len(places), BATCH):
            some = places[begin : begin + BATCH]
            owner = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            flat = np.concatenate([rows[i] for i in some])
            score = np.bincount(owner, weights[flat], minlength=len(some))
            s1 = 1 / (1 + np.exp(-np.clip(score - low, -30, 30)))
            s2 = 1 / (1 + np.exp(-np.clip(score - low - np.exp(log_gap), -30, 30)))
            y, between = grades[some], np.maximum(s1 - s2, 1e-9)
            slope = np.select([y == 0, y == 1], [-s1, 1 - s1 - s2], 1 - s2)
            of_low = np.select([y == 0, y == 1], [s1, -s1 * (1 - s1) / between], 0)
            of_high = np.select([y == 1, y == 2], [s2 * (1 - s2) / between, s2 - 1], 0)
            at, inverse = np.unique(flat, return_inverse=True)
            g = -np.bincount(inverse, slope[owner], minlength=len(at))
            grown = np.sqrt(squares[at] + g**2)
            pulled[at] += g - (grown - np.sqrt(squares[at])) / RATE * weights[at]
            squares[at] += g**2
            beyond = np.maximum(np.abs(pulled[at]) - PULL, 0)
            weights[at] = -np.sign(pulled[at]) * beyond * RATE / (1 + grown)
            t_step = np.array([np.sum(of_low + of_high), np.sum(of_high) * np.exp(log_gap)])
            t_squares += t_step**2
            moved = RATE * t_step / np.sqrt(t_squares)
            low, log_gap = low + moved[0], log_gap + moved[1]
    return Model(weights, (float(low), float(low + np.exp(log_gap))))


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade of each rated document; of several ratings the lowest counts.

    Rows without an id or a quality are no ratings; an unknown toxicity is none.
    """
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) > 0
    grade = F.when(toxic, 0).when(F.col("quality") <= 0, 1).otherwise(2)
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return rated.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def sampled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``grade`` and ``_text`` of the rated documents to fit on, a row per id at most.

    The sample's ids are at most ``SAMPLE`` rows, so they may be broadcast. Of several texts of
    one id the one of lowest hash is taken.
    """
    ids = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    ids = written(ids.select(F.col("doc_id").alias("_id"), "grade"), "ratings")
    texts = documents.select(
        F.col("doc_id").alias("_of"), F.coalesce("text", F.lit("")).alias("_text")
    )
    joined = texts.join(F.broadcast(ids), F.col("_of") == F.col("_id"))
    text = F.struct(F.xxhash64("_text"), "_text")
    one = joined.groupBy("_id", "grade").agg(F.min(text)["_text"].alias("_text"))
    return one.select("grade", "_text")


def trained(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of ``sampled`` documents; their features are made by Spark."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in small_batches(batches, "_text"):
            found = [features(t, hashes) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.array(found, pa.list_(pa.int32()))], ["grade", "found"]
            )

    made = sampled(documents, labels).mapInArrow(rows, "grade int, found array<int>").toArrow()
    # Features stay in the one array that came; as lists of numbers they took ten times that.
    lists, grade = made.column("found").combine_chunks(), made.column("grade").to_numpy()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    found = [flat[begin:end] for begin, end in zip(ends, ends[1:], strict=False)]
    # the same model whatever order the tasks end in: by features, then by grade
    order = sorted(range(len(found)), key=lambda i: (found[i].astype(">i4").tobytes(), grade[i]))
    return fit([found[i] for i in order], grade[order].astype(np.int64))


def scored(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns as ``_row``, and ``expected_grade``, ``p_good`` and ``kept``.

    A NULL text is judged as an empty one. Repeated rows get equal results. Texts are
    taken whole, whatever their length. As the row is one struct, no name can clash.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    given = documents.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    kind = given.select("_row").schema["_row"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in small_batches(batches, "_text"):
            scores = np.array(
                [
                    sent.value.weights[features(t or "", hashes)].sum()
                    for t in batch.column("_text").to_pylist()
                ],
                np.float64,
            )
            tails = sent.value.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(tails.sum(axis=1)), pa.array(tails[:, 1])],
                ["_row", "expected_grade", "p_good"],
            )

    out = given.mapInArrow(rows, f"_row {kind}, expected_grade double, p_good double")
    return out.withColumn("kept", F.col("p_good") >= KEEP_FROM)


def classified(
    documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep``, ``expected_grade``, ``p_good`` and ``kept`` of every row of ``documents``.

    NULL texts are empty ones; ratings of a NULL id or quality are none. Repeated rows get equal
    results, and count once for the fit. With fewer than 30 rated documents no word can be in
    three of them and in a tenth at most: then the shape of a text alone decides. Without any
    rating all rows are kept; an empty table gives no rows. Other columns don't matter.
    """
    if set(keep) & {"expected_grade", "p_good", "kept"}:
        raise ValueError(f"keep has a reserved name: {keep}")
    model = trained(documents, labels)
    out = scored(documents.select(*dict.fromkeys((*keep, "text"))), model)
    return out.select(*(F.col(f"_row.{c}") for c in keep), "expected_grade", "p_good", "kept")


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the classifier keeps, with their columns as they are.

    NULLs, repeated rows and empty tables as in ``classified``.
    """
    return scored(documents, trained(documents, labels)).where("kept").select("_row.*")
