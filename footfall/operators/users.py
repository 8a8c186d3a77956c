"""One row per user: the tables all metrics are computed from.

The event log is the only input that grows without bound, and one user (a bot, a
shared account) may own a large share of it. Both tables below are therefore plain
aggregations: every map task first reduces its own events to one row per key, and a
hot user reaches its reducer as a few rows per map task. Raw events are never
shuffled, sorted or buffered by user.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.functions.times import days, day_number, hours, hours_between, in_window
from footfall.schema import (
    ACTIVATION_HOURS,
    ATTRIBUTION_DAYS,
    FUNNEL_STEPS,
    RETENTION_END_DAYS,
    RETENTION_START_DAYS,
)


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def _steps_seen(steps: Sequence[str]) -> Column:
    """The event types of a group of events as one bit per step.

    One integer buffer takes less room in the shuffle than a boolean per step.
    """
    bit = F.lit(0)
    for place, step in enumerate(steps):
        bit = F.when(_is(step), 1 << place).otherwise(bit)
    return F.bit_or(bit)


def _step_flags(seen: Column, steps: Sequence[str]) -> list[Column]:
    return [
        (seen.bitwiseAND(F.lit(1 << place)) != 0).alias(f"has_{step}")
        for place, step in enumerate(steps)
    ]


def _known_users(events: DataFrame) -> DataFrame:
    return events.where(F.col("user_id").isNotNull())


def user_flags(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """``user_id, has_<step>...``: whether a user has at least one event of each type.

    Users with none of the steps are kept, with all flags false.
    """
    users = _known_users(events).groupBy("user_id").agg(_steps_seen(steps).alias("seen"))
    return users.select("user_id", *_step_flags(F.col("seen"), steps))


def funnel_users(
    events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS, order: str = "any"
) -> DataFrame:
    """``user_flags`` of the users that entered the funnel.

    ``order="any"``: an event of a type is enough, whenever it was. ``order="time"``: a flag is
    set if the user reached the step in order, see ``ordered_times``; users without the first
    step are left out. The event types are filtered first, so the filter reaches the file scan.
    """
    if order not in ("any", "time"):
        raise ValueError(f"order must be 'any' or 'time', not {order!r}")
    if order == "any":
        return user_flags(events.where(F.col("event_type").isin(*steps)), steps)
    flags = [F.col(f"{step}_ts").isNotNull().alias(f"has_{step}") for step in steps]
    return ordered_times(events, steps).select("user_id", *flags)


def _period(ts: Column, period_days: int) -> Column:
    day = day_number(ts)
    return day - F.pmod(day, F.lit(period_days))


def step_periods(
    events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS, period_days: int = 1
) -> DataFrame:
    """``user_id, period, first_<i>, last_<i>...``: a user's first and last event of each step
    in each period. Tables of parts of a log are merged by minimum and maximum."""
    ts = F.col("event_timestamp")
    known = _known_users(events).where(F.col("event_type").isin(*steps) & ts.isNotNull())
    ends = []
    for place, step in enumerate(steps):
        of_step = F.when(_is(step), ts)
        ends += [F.min(of_step).alias(f"first_{place}"), F.max(of_step).alias(f"last_{place}")]
    return known.groupBy("user_id", _period(ts, period_days).alias("period")).agg(*ends)


def ordered_times(
    events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS, period_days: int = 1
) -> DataFrame:
    """``user_id, <step>_ts...``: when a user reached each step in order, NULL from the first
    step that was not reached.

    A step is reached by its earliest event that is not before the one that reached the step
    before it; events of the same instant are in order. Users without the first step are left
    out, and so are events without timestamp.

    No plain minimum over a user's events gives these times, as an earlier event may be too
    early. They follow from the first and last event of each type and period: where a
    period's first event of a step is late enough, it is the earliest one there, and where
    its last one is too early, there is none. Only in the period that holds the time to be
    late for can there be some of both; only for such users, and of that period, the events
    themselves are looked up. So a hot user costs a row per task and period, and raw events are
    shuffled only where their order is in doubt.
    """
    if len(set(steps)) != len(steps) or not steps:
        raise ValueError(f"steps must be distinct, and one at least, not {list(steps)!r}")
    periods = step_periods(events, steps, period_days)
    ts = F.col("event_timestamp")
    times = periods.groupBy("user_id").agg(F.min("first_0").alias(f"{steps[0]}_ts"))
    times = times.where(F.col(f"{steps[0]}_ts").isNotNull())
    for place, step in enumerate(steps[1:], 1):
        since, first, last = F.col("since"), F.col(f"first_{place}"), F.col(f"last_{place}")
        reached = times.select("user_id", F.col(f"{steps[place - 1]}_ts").alias("since"))
        of_step = periods.where(first.isNotNull()).select("user_id", "period", first, last)
        found = (
            of_step.join(reached.where(since.isNotNull()), "user_id")
            .groupBy("user_id")
            .agg(
                F.min(F.when(first >= since, first)).alias("sure"),
                F.max(F.when((first < since) & (last >= since), F.col("period"))).alias("period"),
                F.first("since").alias("since"),
            )
        )
        doubtful = found.where(F.col("period").isNotNull()).select("user_id", "period", "since")
        raw = _known_users(events).where(_is(step) & ts.isNotNull())
        looked_up = (
            raw.select("user_id", _period(ts, period_days).alias("period"), ts)
            .join(doubtful, ["user_id", "period"])
            .where(ts >= since)
            .groupBy("user_id")
            .agg(F.min(ts).alias("within"))
        )
        # what is found within the doubtful period precedes all later periods
        at = found.join(looked_up, "user_id", "left").select(
            "user_id", F.coalesce("within", "sure").alias(f"{step}_ts")
        )
        times = times.join(at, "user_id", "left")
    return times


def user_periods(
    events: DataFrame, period_days: int, steps: Sequence[str] = FUNNEL_STEPS
) -> DataFrame:
    """Roll the log up to one row per user and period of ``period_days`` days.

    Keeps the event types seen, the first and last event, the first middle step and the
    first and last final step of each period. A user has at most one row per period of the
    log's calendar span, however many events that is.
    """
    _, middle, last = steps
    ts = F.col("event_timestamp")
    return (
        _known_users(events)
        .groupBy("user_id", _period(ts, period_days).alias("period"))
        .agg(
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            F.min(F.when(_is(middle), ts)).alias("first_middle_ts"),
            F.min(F.when(_is(last), ts)).alias("first_final_ts"),
            F.max(F.when(_is(last), ts)).alias("last_final_ts"),
            _steps_seen(steps).alias("seen"),
        )
    )


def _single_events(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """The columns of ``user_periods`` with each event a period of its own."""
    _, middle, last = steps
    ts = F.col("event_timestamp")
    seen = F.lit(0)
    for place, step in enumerate(steps):
        seen = F.when(_is(step), 1 << place).otherwise(seen)
    final = F.when(_is(last), ts)
    return _known_users(events).select(
        "user_id",
        ts.alias("first_ts"),
        ts.alias("last_ts"),
        F.when(_is(middle), ts).alias("first_middle_ts"),
        final.alias("first_final_ts"),
        final.alias("last_final_ts"),
        seen.alias("seen"),
    )


def merged_periods(periods: DataFrame) -> DataFrame:
    """Period rows of several tables, one row per user and period again."""
    return periods.groupBy("user_id", "period").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min("first_middle_ts").alias("first_middle_ts"),
        F.min("first_final_ts").alias("first_final_ts"),
        F.max("last_final_ts").alias("last_final_ts"),
        F.bit_or("seen").alias("seen"),
    )


def merge_periods(periods: DataFrame, more: DataFrame) -> DataFrame:
    """``user_periods`` of a log, from those of its parts: the state that facts are kept by.

    Every column is a minimum, a maximum or a union, so parts may overlap in time, come late or
    be merged in any order; a part that is merged twice changes nothing.
    """
    return merged_periods(periods.unionByName(more))


def period_length(
    retention_days: tuple[int, int] = (RETENTION_START_DAYS, RETENTION_END_DAYS),
    attribution_days: int = ATTRIBUTION_DAYS,
) -> int:
    """Days of a period of ``user_periods`` that facts with these windows need."""
    start, end = retention_days
    if end <= start or attribution_days < 1:
        raise ValueError("windows must span at least one day")
    return min(end - start, attribution_days)


def advanced(
    periods: DataFrame, facts: DataFrame, new_events: DataFrame, **options: object
) -> tuple[DataFrame, DataFrame]:
    """(periods, facts) of a log that ``new_events`` were added to.

    ``periods`` and ``facts`` are those of the log so far, made with the same options, which are
    ``user_facts``'s but for ``strategy``. Only users with new events are computed again, from
    their periods; no event of the log so far is read. New events may be of any time.
    """
    shape = {k: options[k] for k in ("retention_days", "attribution_days") if k in options}
    steps = {k: options[k] for k in ("steps",) if k in options}
    delta = user_periods(new_events, period_length(**shape), **steps)
    touched = delta.select("user_id").distinct()
    fresh = facts_of_periods(
        merge_periods(periods.join(touched, "user_id", "left_semi"), delta), **options
    )
    kept = facts.join(touched, "user_id", "left_anti")
    return merge_periods(periods, delta), kept.unionByName(fresh)


def user_facts(
    events: DataFrame,
    steps: Sequence[str] = FUNNEL_STEPS,
    retention_days: tuple[int, int] = (RETENTION_START_DAYS, RETENTION_END_DAYS),
    attribution_days: int = ATTRIBUTION_DAYS,
    activation_hours: int = ACTIVATION_HOURS,
    strategy: str = "rollup",
) -> DataFrame:
    """Everything the funnel, retention and experiment metrics need of a user.

    Columns (for the default steps): ``user_id``, ``has_view``, ``has_cart``,
    ``has_purchase``, ``first_event_ts``, ``first_cart_ts``, ``week1_active`` (any event
    in ``[first_event + 7d, first_event + 14d)``), ``purchase_within_7d`` (a purchase in
    ``[first_cart, first_cart + 7d)``), ``time_to_activation_hours`` (first event to a
    purchase in ``[first_event, first_event + 24h)``) and ``activated``.

    The window tests need each user's first event before its other events can be judged.
    Instead of joining events back to that anchor, they are answered on the rolled-up
    periods, exactly: with periods no longer than a window, no period reaches over both
    ends of it, so a period has an event in the window if and only if its first or its
    last event is in it.

    ``strategy="window"`` gives the same table from each user's raw events, one shuffle
    and sort of all of them. It takes half the time on logs with hardly more than one event
    per user, but a hot user's events go through one task.

    A user whose window runs past the end of the log counts as not retained.
    """
    if strategy not in ("rollup", "window"):
        raise ValueError(f"strategy must be 'rollup' or 'window', not {strategy!r}")
    length = period_length(retention_days, attribution_days)
    if strategy == "rollup":
        periods = user_periods(events, length, steps)
    else:
        periods = _single_events(events, steps)
    return facts_of_periods(periods, steps, retention_days, attribution_days, activation_hours)


def facts_of_periods(
    periods: DataFrame,
    steps: Sequence[str] = FUNNEL_STEPS,
    retention_days: tuple[int, int] = (RETENTION_START_DAYS, RETENTION_END_DAYS),
    attribution_days: int = ATTRIBUTION_DAYS,
    activation_hours: int = ACTIVATION_HOURS,
) -> DataFrame:
    """``user_facts`` from ``user_periods`` of ``period_length`` days at most."""
    _, middle, last = steps
    start, end = retention_days
    by_user = Window.partitionBy("user_id")
    anchored = periods.withColumns({
        "first_event_ts": F.min("first_ts").over(by_user),
        "first_cart_ts": F.min("first_middle_ts").over(by_user),
    })

    first_event, first_cart = F.col("first_event_ts"), F.col("first_cart_ts")

    def touches(low: str, high: str, window_start: Column, window_end: Column) -> Column:
        return F.bool_or(
            in_window(F.col(low), window_start, window_end)
            | in_window(F.col(high), window_start, window_end)
        )

    # The first event precedes every final step, so the earliest one decides activation.
    first_final = F.min("first_final_ts")
    anchor = F.min("first_event_ts")
    facts = anchored.groupBy("user_id").agg(
        *_step_flags(F.bit_or("seen"), steps),
        anchor.alias("first_event_ts"),
        F.min("first_cart_ts").alias(f"first_{middle}_ts"),
        touches("first_ts", "last_ts", first_event + days(start), first_event + days(end))
        .alias("week1_active"),
        touches("first_final_ts", "last_final_ts", first_cart, first_cart + days(attribution_days))
        .alias(f"{last}_within_{attribution_days}d"),
        F.when(
            in_window(first_final, anchor, anchor + hours(activation_hours)),
            hours_between(anchor, first_final),
        ).alias("time_to_activation_hours"),
    )
    return facts.withColumn("activated", F.col("time_to_activation_hours").isNotNull())
