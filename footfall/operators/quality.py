"""Checks on the event log as it was delivered, before any row is left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from footfall.functions.text import is_missing
from footfall.functions.times import has_zone, parsed_timestamp
from footfall.schema import EVENT_TYPES


def missing_keys(events: DataFrame) -> DataFrame:
    """One row: events without user, type (NULL or blank) or timestamp (NULL)."""
    return events.agg(
        F.count_if(is_missing(F.col("user_id"))).alias("missing_user_id"),
        F.count_if(is_missing(F.col("event_type"))).alias("missing_event_type"),
        F.count_if(F.col("event_timestamp").isNull()).alias("missing_event_timestamp"),
    )


def unexpected_event_types(
    events: DataFrame, domain: Sequence[str] = EVENT_TYPES
) -> DataFrame:
    """``event_type, cnt`` of the types outside the domain. NULL types are left to
    ``missing_keys``."""
    return (
        events.where(~F.col("event_type").isin(*domain))
        .groupBy("event_type")
        .agg(F.count("*").alias("cnt"))
    )


def bad_timestamps(
    raw_events: DataFrame, pattern: str | None = None, zone: str = "UTC"
) -> DataFrame:
    """One row: how many timestamps are given as text that does not parse.

    ``raw_events.event_timestamp`` is text, as ``sources.read_raw_events`` returns it;
    ``pattern`` and ``zone`` are the reader's.
    """
    text = F.col("event_timestamp")
    parsed = parsed_timestamp(text, pattern, zone)
    return raw_events.agg(
        F.count("*").alias("events"),
        F.count_if(text.isNull()).alias("missing_timestamps"),
        F.count_if(text.isNotNull() & parsed.isNull()).alias("unparsable_timestamps"),
    )


def timestamp_forms(raw_events: DataFrame, pattern: str | None = None) -> DataFrame:
    """One row: how many timestamps are given with and without a zone of their own.

    Readers take the former at their word and the latter as times of one zone, so a log
    that has both may mix clocks.
    """
    text = F.col("event_timestamp")
    good = parsed_timestamp(text, pattern).isNotNull()
    zoned = has_zone(text, pattern)
    return raw_events.agg(
        F.count_if(good & zoned).alias("with_zone"),
        F.count_if(good & ~zoned).alias("without_zone"),
    )


def judged(
    raw_events: DataFrame,
    domain: Sequence[str] = EVENT_TYPES,
    pattern: str | None = None,
    zone: str = "UTC",
) -> DataFrame:
    """The log as delivered, with ``parsed_timestamp`` and ``reasons``: what is wrong with a row.

    ``reasons`` is empty for good rows, and else holds, in this order: ``missing_user_id``,
    ``missing_event_type`` or ``unexpected_event_type``, ``missing_event_timestamp`` or
    ``unparsable_timestamp``.
    """
    text, kind = F.col("event_timestamp"), F.col("event_type")
    parsed = parsed_timestamp(text, pattern, zone)
    no_type = is_missing(kind)
    faults = {
        "missing_user_id": is_missing(F.col("user_id")),
        "missing_event_type": no_type,
        "unexpected_event_type": ~no_type & ~kind.isin(*domain),
        "missing_event_timestamp": text.isNull(),
        "unparsable_timestamp": text.isNotNull() & F.col("parsed_timestamp").isNull(),
    }
    reasons = F.array_compact(F.array(*[F.when(test, name) for name, test in faults.items()]))
    return raw_events.withColumn("parsed_timestamp", parsed).withColumn("reasons", reasons)


def good_events(judged_events: DataFrame) -> DataFrame:
    """The rows without fault, timestamps parsed, with the columns of the log."""
    names = [c for c in judged_events.columns if c not in ("parsed_timestamp", "reasons")]
    good = judged_events.where(F.size("reasons") == 0)
    return good.withColumn("event_timestamp", F.col("parsed_timestamp")).select(*names)


def quarantined(judged_events: DataFrame) -> DataFrame:
    """The other rows as they were delivered, with their ``reasons``."""
    return judged_events.where(F.size("reasons") > 0).drop("parsed_timestamp")


def quarantine_counts(judged_events: DataFrame) -> DataFrame:
    """``reason, cnt``: rows with each fault, and ``(good)`` and ``(quarantined)`` rows.

    A row with two faults counts for both, and once as quarantined, so that good and
    quarantined rows are all rows.
    """
    whole = F.when(F.size("reasons") == 0, "(good)").otherwise("(quarantined)")
    reasons = judged_events.select(F.explode(F.concat("reasons", F.array(whole))).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("cnt"))
