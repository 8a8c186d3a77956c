"""Random logs against a plain Python count, and numeric helpers against the library."""

from __future__ import annotations

import hashlib
import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.functions.stats import two_sided_p
from footfall.functions.variants import md5_variant
from footfall.operators import experiment
from footfall.operators.quantiles import grouped_median
from footfall.operators.users import user_facts

EVENTS = "user_id STRING, product_id STRING, event_type STRING, event_timestamp TIMESTAMP_NTZ"
TYPES = ("view", "cart", "purchase", "wishlist", None)


def random_log(seed, users=60, span_days=40, per_user=9):
    """Events at few distinct hours, so that they often fall on a window's edge.

    The span reaches back over 1970, where day numbers change sign.
    """
    rng = random.Random(seed)
    origin = datetime(1969, 12, 20) if seed % 2 else datetime(2024, 2, 20)
    rows = []
    for user in range(users):
        for _ in range(rng.randint(1, per_user)):
            when = origin + timedelta(hours=12 * rng.randint(0, 2 * span_days))
            if rng.random() < 0.05:
                when = None
            elif rng.random() < 0.3:
                when += timedelta(microseconds=rng.choice((-1, 1)))
            rows.append((f"u{user}", None, rng.choice(TYPES), when))
    return rows


def expected_facts(rows, start, end, attribution, activation):
    by_user = {}
    for user, _, kind, when in rows:
        by_user.setdefault(user, []).append((kind, when))
    out = {}
    for user, events in by_user.items():
        timed = [(k, t) for k, t in events if t is not None]
        first = min((t for _, t in timed), default=None)
        first_cart = min((t for k, t in timed if k == "cart"), default=None)
        day, hour = timedelta(days=1), timedelta(hours=1)
        delays = [
            t - first for k, t in timed if k == "purchase" and t - first < activation * hour
        ]
        out[user] = (
            any(k == "view" for k, _ in events),
            any(k == "cart" for k, _ in events),
            any(k == "purchase" for k, _ in events),
            first,
            first_cart,
            any(start * day <= t - first < end * day for _, t in timed),
            first_cart is not None and any(
                k == "purchase" and timedelta(0) <= t - first_cart < attribution * day
                for k, t in timed
            ),
            min(delays) / hour if delays else None,
        )
    return out


@pytest.mark.parametrize("seed, windows", [
    (1, (7, 14, 7, 24)), (2, (7, 14, 7, 24)), (3, (1, 2, 3, 12)), (4, (0, 5, 1, 36)),
    (5, (3, 13, 4, 24)), (6, (14, 28, 10, 48)),
])
def test_user_facts(spark, seed, windows):
    start, end, attribution, activation = windows
    rows = random_log(seed)
    facts = user_facts(
        spark.createDataFrame(rows, EVENTS).repartition(5),
        retention_days=(start, end),
        attribution_days=attribution,
        activation_hours=activation,
    )
    found = {r.user_id: tuple(r)[1:8] for r in facts.collect()}
    hours = {r.user_id: r.time_to_activation_hours for r in facts.collect()}
    expected = expected_facts(rows, start, end, attribution, activation)
    assert set(found) == set(expected)
    for user, row in expected.items():
        assert found[user] == row[:7]
        assert hours[user] == pytest.approx(row[7], abs=1e-10)


def test_windows_of_no_length_are_refused(spark):
    events = spark.createDataFrame([], EVENTS)
    with pytest.raises(ValueError):
        user_facts(events, retention_days=(7, 7))
    with pytest.raises(ValueError):
        user_facts(events, attribution_days=0)


@pytest.mark.parametrize("seed, upper", [(1, 10), (2, 1000), (3, 86_400_000_000), (4, 1), (5, 17)])
def test_grouped_median(spark, seed, upper):
    rng = random.Random(seed)
    groups = {}
    for name, size in {"one": 1, "two": 2, "odd": 101, "even": 100, "hot": 500}.items():
        values = [rng.randrange(upper) for _ in range(size)]
        if name == "hot":  # one value holds most of the group
            values[: size * 2 // 3] = [upper // 2] * (size * 2 // 3)
        groups[name] = values
    rows = [(g, v) for g, values in groups.items() for v in values] + [("odd", None), ("none", None)]
    df = spark.createDataFrame(rows, "g STRING, v LONG").repartition(4)
    counts = df.withColumns({
        "w": F.when(F.col("v").isNull(), 0).otherwise(1), "v": F.coalesce("v", F.lit(-1))
    })
    medians = grouped_median(counts, "g", "v", F.col("w"), upper).collect()
    found = {r.g: (r.low, r.high) for r in medians}
    assert found == {
        g: (statistics.median_low(v), statistics.median_high(v)) for g, v in groups.items()
    }


def test_exact_and_approximate_readout(spark):
    rows = random_log(12, users=400, span_days=3, per_user=6)
    facts = user_facts(spark.createDataFrame(rows, EVENTS))
    expected = {}
    for row in facts.where("has_cart and activated").collect():
        odd = int(hashlib.md5(row.user_id.encode()).hexdigest(), 16) % 2
        expected.setdefault("B_treatment" if odd else "A_control", []).append(
            row.time_to_activation_hours
        )
    exact = {r.variant: r for r in experiment.ab_results(facts).collect()}
    rough = {r.variant: r for r in experiment.ab_results(facts, approx=True).collect()}
    assert set(exact) == set(expected)
    for variant, hours in expected.items():
        assert exact[variant].median_time_to_activation_hours == pytest.approx(
            statistics.median(hours), rel=1e-12
        )
        assert exact[variant].mean_time_to_activation_hours == pytest.approx(
            statistics.fmean(hours), rel=1e-12
        )
        assert rough[variant].median_time_to_activation_hours in [
            pytest.approx(h, rel=1e-12) for h in hours
        ]
        same = [c for c in exact[variant].asDict() if not c.startswith("median")]
        assert all(exact[variant][c] == rough[variant][c] for c in same)


def test_variant_is_parity_of_the_whole_digest(spark):
    ids = [f"user-{i}" for i in range(500)] + ["", "ü", "123"]
    df = spark.createDataFrame([(i,) for i in ids], "id STRING")
    found = dict(df.select("id", md5_variant(F.col("id"))).collect())
    for user, variant in found.items():
        odd = int(hashlib.md5(user.encode("utf-8")).hexdigest(), 16) % 2
        assert variant == ("B_treatment" if odd else "A_control")


def test_variant_of_numeric_ids(spark):
    row = spark.range(1).select(md5_variant(F.lit(42)), md5_variant(F.lit("42"))).first()
    assert row[0] == row[1]


def test_p_value(spark):
    zs = [0.0, 1e-9, 0.05, 0.5, 1.0, 1.959963984540054, 3.0, 5.0, 7.0, 8.2, 12.0, 60.0]
    zs += [-z for z in zs] + [None]
    df = spark.createDataFrame([(z,) for z in zs], "z DOUBLE")
    for z, p in df.select("z", two_sided_p(F.col("z"))).collect():
        if z is None:
            assert p is None
        else:
            assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-15)
