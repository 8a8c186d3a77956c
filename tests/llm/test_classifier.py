"""The ordinal classifier against plain loops of the same loss."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pytest

from conftest import table_dir
from footfall.llm import quality_classifier as qc
from footfall.llm import queries

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def log_loss(score, grade, low, high):
    """-log P(grade) of a cumulative link model."""
    tails = [1.0, sigmoid(score - low), sigmoid(score - high), 0.0]
    return -math.log(tails[grade] - tails[grade + 1])


def slope_by_difference(score, grade, low, high, of, by=1e-6):
    """Of the loss, by the score (0), the low threshold (1) or the high one (2)."""
    at = [score, low, high]
    out = []
    for sign in (1, -1):
        moved = list(at)
        moved[of] += sign * by
        out.append(log_loss(moved[0], grade, moved[1], moved[2]))
    return (out[0] - out[1]) / (2 * by)


def plain_fit(rows, grades):
    """FTRL, one feature and one document after another, slopes by finite differences."""
    counts = {}
    for row in rows:
        for f in row:
            counts[f] = counts.get(f, 0) + 1
    used = {
        f for f, n in counts.items()
        if n >= qc.MIN_DOCUMENTS and (f >= qc.BUCKETS or n <= qc.MAX_SHARE * len(rows))
    }
    rows = [[f for f in row if f in used] for row in rows]
    share = [(sum(g < k for g in grades) + 0.5 * k) / (len(grades) + 1.5) for k in (1, 2)]
    low, start = (math.log(s / (1 - s)) for s in share)
    log_gap = math.log(max(0.05, start - low))
    squares_t = [1.0, 1.0]
    pulled, squares, weights = ({f: 0.0 for f in used} for _ in range(3))
    order = np.random.default_rng(0)
    for _ in range(-(-qc.STEPS * qc.BATCH // len(rows))):
        places = order.permutation(len(rows))
        for begin in range(0, len(places), qc.BATCH):
            slopes, t = {}, [0.0, 0.0]
            high = low + math.exp(log_gap)
            for i in places[begin : begin + qc.BATCH]:
                score = sum(weights[f] for f in rows[i])
                by_score, by_low, by_high = (
                    slope_by_difference(score, grades[i], low, high, of) for of in range(3)
                )
                for f in rows[i]:
                    slopes[f] = slopes.get(f, 0.0) + by_score
                t[0] -= by_low + by_high
                t[1] -= by_high * math.exp(log_gap)
            for f, g in slopes.items():
                grown = math.sqrt(squares[f] + g * g)
                pulled[f] += g - (grown - math.sqrt(squares[f])) / qc.RATE * weights[f]
                squares[f] += g * g
                beyond = max(abs(pulled[f]) - qc.PULL, 0.0)
                weights[f] = -math.copysign(beyond, pulled[f]) * qc.RATE / (1 + grown)
            for k in range(2):
                squares_t[k] += t[k] ** 2
                t[k] *= qc.RATE / math.sqrt(squares_t[k])
            low, log_gap = low + t[0], log_gap + t[1]
    return weights, (low, low + math.exp(log_gap))


def test_fit_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(qc, "STEPS", 60)
    monkeypatch.setattr(qc, "PULL", 2.0)
    rng = random.Random(4)
    grades, rows = [], []
    for _ in range(90):
        grade = rng.choices([0, 1, 2], (2, 3, 5))[0]
        telling = rng.sample(range(100 * grade, 100 * grade + 12), 3)
        row = {*telling, *rng.sample(range(1000, 1060), 4), qc.BUCKETS + rng.randrange(3)}
        rows.append(np.array(sorted(row), np.int32))
        grades.append(grade)
    model = qc.fit(rows, np.array(grades))
    weights, thresholds = plain_fit([r.tolist() for r in rows], grades)
    assert model.thresholds == pytest.approx(thresholds, rel=1e-4)
    assert sum(w != 0 for w in weights.values()) > 10
    assert {f: model.weights[f] for f in weights} == pytest.approx(weights, abs=1e-4)
    assert np.count_nonzero(model.weights) == sum(w != 0 for w in weights.values())


def test_query_is_the_model_applied(spark):
    sf = table_dir("0.001")
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = qc.trained(documents, labels)
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    found = {r.doc_id: r for r in queries.queries()["op10_quality_classifier"](spark, sf).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        score = sum(model.weights[f] for f in qc.features(text, qc._Hashes()))
        tails = [sigmoid(score - t) for t in model.thresholds]
        assert found[i].p_good == pytest.approx(tails[1], rel=1e-9)
        assert found[i].expected_grade == pytest.approx(sum(tails), rel=1e-9)
        assert found[i].kept == (found[i].p_good >= qc.KEEP_FROM)


def test_repeated_ids_count_once(spark):
    rows = [(1, f"text {i % 7}") for i in range(500)] + [(2, None), (2, "other"), (3, "third")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert qc.sampled(documents, labels).count() == 2


def test_features_come_to_the_driver_as_arrays(spark, monkeypatch):
    """4 bytes a feature, not a Python number each."""
    texts = [" ".join(f"{a}{b}{c}{i % 7}x" for a in LETTERS for b in LETTERS for c in "klmno"[: 2 + i % 4])
             .translate(str.maketrans("0123456", "pqrstuv")) for i in range(60)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int"
    )
    given = []

    def fit(rows, grades):
        given.append((rows, grades))
        return qc.Model(np.zeros(qc.BUCKETS + qc.SHAPES), (0.0, 1.0))

    monkeypatch.setattr(qc, "fit", fit)
    qc.trained(documents, labels)
    tracemalloc.start()
    qc.trained(documents, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    (first, grades), (rows, again) = given
    hashes = qc._Hashes()
    expected = sorted((qc.features(t, hashes).tolist(), 1 + i % 2) for i, t in enumerate(texts))
    assert [r.tolist() for r in rows] == [f for f, _ in expected] == [r.tolist() for r in first]
    assert again.tolist() == [g for _, g in expected] == grades.tolist()
    features = sum(map(len, rows))
    assert features > 100_000 and peak - 8 * (qc.BUCKETS + qc.SHAPES) < 16 * features
