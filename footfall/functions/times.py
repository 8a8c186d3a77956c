"""Event-time expressions on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_HOUR = 3_600_000_000


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """Half-open membership ``start <= ts < end``; false, not NULL, on a missing side."""
    return F.coalesce((ts >= start) & (ts < end), F.lit(False))


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed time in fractional hours, at microsecond precision."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros.cast("double") / F.lit(float(MICROS_PER_HOUR))


def micros_from_hours(value: Column) -> Column:
    """Back from fractional hours to whole microseconds.

    Exact for any duration below 2**52 microseconds (142 years): the double's error
    is far less than half a microsecond.
    """
    return F.round(value * F.lit(float(MICROS_PER_HOUR))).cast("long")


def utc_time(instant: Column) -> Column:
    """A TIMESTAMP as TIMESTAMP_NTZ in UTC; a cast would take the session's zone."""
    micros = F.unix_micros(instant).cast("decimal(20,0)")
    since = F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since


# A time of day followed by an offset or the name of a zone.
ZONED = r"\d:\d{1,2}(:\d{1,2}(\.\d*)?)?\s*[A-Za-z+-]"
# Letters of a datetime pattern that stand for an offset or a zone.
ZONE_LETTERS = set("VzOXxZ")


def has_zone(text: Column, pattern: str | None = None) -> Column:
    """The text has an offset or zone of its own; with a ``pattern`` the pattern tells."""
    return text.rlike(ZONED) if pattern is None else F.lit(pattern_has_zone(pattern))


def pattern_has_zone(pattern: str) -> bool:
    return bool(ZONE_LETTERS & set("".join(pattern.split("'")[::2])))


def parsed_timestamp(text: Column, pattern: str | None = None, zone: str = "UTC") -> Column:
    """Text to TIMESTAMP_NTZ in UTC; NULL where it does not parse, in ANSI mode too.

    Without a ``pattern`` ISO texts are read. Texts without a zone are times of ``zone``.
    """

    def in_utc(wall: Column) -> Column:
        return wall if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)

    if pattern is None:
        # one instant, from the text as it is or with an offset; the test runs once per row
        zoned = F.when(has_zone(text), text)
        instant = zoned.try_cast("timestamp")
        wall = F.when(zoned.isNull(), text).try_cast("timestamp_ntz")
        return F.coalesce(utc_time(instant), in_utc(wall))
    if pattern_has_zone(pattern):
        return utc_time(F.try_to_timestamp(text, F.lit(pattern)))
    # an offset of nought, as there is no form for times without zone that doesn't fail
    instant = F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(f"{pattern} xxx"))
    return in_utc(utc_time(instant))


def day_number(ts: Column) -> Column:
    """Whole days since 1970-01-01."""
    return F.unix_date(F.to_date(ts))


def cohort_label(ts: Column, grain: str) -> Column:
    """Calendar period as sortable text: ``month`` (``2024-03``) or ``day`` (``2024-03-01``)."""
    if grain not in ("month", "day"):
        raise ValueError(f"grain must be 'month' or 'day', not {grain!r}")
    day = F.to_date(ts).cast("string")
    return F.left(day, F.lit(len("yyyy-MM"))) if grain == "month" else day
