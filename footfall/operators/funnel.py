"""User-level conversion funnel.

Membership needs one event of a type, in any order, or, with users of ``funnel_users(order="time")``,
the steps one after another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.functions.rates import percent, ratio
from footfall.schema import FUNNEL_STEPS


def _has(step: str) -> Column:
    return F.col(f"has_{step}")


def _users(condition: Column) -> Column:
    return F.count_if(condition)


def _stage_structs(steps: Sequence[str]) -> list[Column]:
    return [F.struct(F.lit(s).alias("stage"), _users(_has(s)).alias("users")) for s in steps]


def _rate_structs(steps: Sequence[str], mode: str) -> list[Column]:
    if mode not in ("loose", "strict"):
        raise ValueError(f"mode must be 'loose' or 'strict', not {mode!r}")
    first, middle, last = map(_has, steps)
    a, b, c = steps
    strict = mode == "strict"
    empty = None if strict else 0.0
    rates = {
        f"{a}_to_{b}": ratio(_users(first & middle if strict else middle), _users(first), empty),
        f"{b}_to_{c}_strict": ratio(_users(middle & last), _users(middle), empty),
        f"{a}_to_{c}_overall": ratio(_users(first & last if strict else last), _users(first), empty),
    }
    return [F.struct(F.lit(name).alias("metric"), rate.alias("rate")) for name, rate in rates.items()]


def funnel_stages(users: DataFrame, steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """``stage, users``: distinct users per step, in funnel order.

    ``users`` is ``user_flags`` or ``user_facts``; the three counts come from one
    aggregate over it and are turned into rows afterwards.
    """
    return users.agg(F.array(*_stage_structs(steps)).alias("stages")).select(F.inline("stages"))


def funnel_rates(
    users: DataFrame, mode: str = "loose", steps: Sequence[str] = FUNNEL_STEPS
) -> DataFrame:
    """``metric, rate, rate_pct`` of the three conversions.

    ``loose``: the numerators of the rates out of the first step are all users of the
    later step, and an empty denominator gives 0. ``strict``: numerators are
    intersected with the denominator, and an empty denominator gives NULL. The rate
    between the middle and the last step is always intersected.
    """
    rates = users.agg(F.array(*_rate_structs(steps, mode)).alias("rates")).select(F.inline("rates"))
    return rates.withColumn("rate_pct", percent(F.col("rate")))


def funnel_long(users: DataFrame, steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """Every stage paired with every loose rate (nine rows).

    Both lists are unfolded from one aggregated row, so no join is involved.
    """
    both = users.agg(
        F.array(*_stage_structs(steps)).alias("stages"),
        F.array(*_rate_structs(steps, "loose")).alias("rates"),
    )
    return (
        both.select("rates", F.inline("stages"))
        .select("stage", "users", F.inline("rates"))
        .withColumn("rate_pct", percent(F.col("rate")))
    )


def funnel_wide(users: DataFrame, steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """Counts and strict rates side by side, in one row."""
    first, middle, last = map(_has, steps)
    a, b, c = steps
    return users.agg(
        _users(first).alias(f"{a}_users"),
        _users(middle).alias(f"{b}_users"),
        _users(last).alias(f"{c}_users"),
        ratio(_users(first & middle), _users(first)).alias(f"{a}_to_{b}_conversion"),
        ratio(_users(middle & last), _users(middle)).alias(f"{b}_to_{c}_conversion_strict"),
        ratio(_users(first & last), _users(first)).alias(f"{a}_to_{c}_conversion_overall"),
    )


def funnel_leaks(users: DataFrame, steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """``step_no, stage, users, lost_users, lost_rate, largest_leak`` against the step before.

    The share lost is conditional on the step before, and the step that loses the largest
    share is flagged. The windows run over the three aggregated stage rows.
    """
    stages = users.agg(F.array(*_stage_structs(steps)).alias("stages")).select(
        F.posexplode("stages").alias("pos", "s")
    )
    in_order = Window.orderBy("step_no")
    lost = stages.select(
        (F.col("pos") + 1).alias("step_no"), F.col("s.stage"), F.col("s.users")
    ).withColumn("lost_users", F.lag("users").over(in_order) - F.col("users"))
    lost = lost.withColumn(
        "lost_rate", ratio(F.col("lost_users"), F.col("lost_users") + F.col("users"))
    )
    largest = F.max("lost_rate").over(Window.partitionBy())
    return lost.withColumn(
        "largest_leak", F.coalesce(F.col("lost_rate") == largest, F.lit(False))
    )


def users_in_both(users: DataFrame, one: str, other: str) -> DataFrame:
    """Set intersection: ids of the users with both event types."""
    return users.where(_has(one) & _has(other)).select("user_id")


def users_without(users: DataFrame, missing: str, having: str | None = None) -> DataFrame:
    """Set difference: ids of the users without one event type (but with another)."""
    rest = users.where(~_has(missing))
    return (rest if having is None else rest.where(_has(having))).select("user_id")


def tracking_gaps(users: DataFrame, steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """Users that skip a logged step, and the conversion rate if they are let in.

    ``users`` must cover the whole log (``user_flags``, not ``funnel_users``): users with
    none of the funnel's events count as viewless too.
    """
    first, middle, last = map(_has, steps)
    a, b, c = steps
    looser = ratio(_users(last), _users(middle))
    return users.agg(
        _users(~first).alias(f"users_without_{a}"),
        _users(last & ~middle).alias(f"{c}_users_without_{b}"),
        _users(middle & last).alias(f"{b}_and_{c}_users"),
        ratio(_users(middle & last), _users(middle)).alias("strict_rate"),
        looser.alias("looser_rate"),
        percent(looser, 1).alias("looser_rate_pct"),
    )
