"""Exact grouped median without gathering a group in one task.

``median`` and ``percentile`` keep all distinct values of a group in one buffer, and a
window over the group sorts it in one task. With two experiment variants that is the
whole population in two tasks. Here the median's position is found in two rounds of
counting, each over a number of keys that the values' range bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def grouped_median(
    counts: DataFrame, group: str, value: str, weight: Column, upper: int
) -> DataFrame:
    """``group, low, high``: the middle values of an integer column in ``[0, upper)``.

    ``counts`` has rows of group and value that occur ``weight`` times; rows of one value
    may repeat, and those of weight 0 count for nothing. ``low`` and ``high`` are the same
    unless the group has an even number of values; the median is their mean. Groups
    without any weight are left out.

    Values are counted per range of ``w`` consecutive integers, ``w`` a power of two of
    about ``sqrt(upper)``. The first round finds the at most two ranges that hold the
    middle positions; the second counts the distinct values within those. Neither orders
    more than ``upper / w`` or ``w`` rows per group and range.
    """
    bits = (max(upper - 1, 0).bit_length() + 1) // 2
    # Group and range are never NULL, so the join below adds no filter of its own and
    # both rounds read the same shuffle of the counts.
    counts = counts.select(
        F.coalesce(group, F.lit("")).alias(group),
        F.col(value).alias("value"),
        weight.alias("n"),
        F.coalesce(F.shiftright(value, bits), F.lit(-1)).alias("bucket"),
    )

    in_group = Window.partitionBy(group)
    so_far = in_group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        counts.groupBy(group, "bucket")
        .agg(F.sum("n").alias("n"))
        .withColumns({
            "before": F.sum("n").over(so_far) - F.col("n"),
            "total": F.sum("n").over(in_group),
        })
        .withColumns({
            "mid_low": F.floor((F.col("total") - 1) / 2),
            "mid_high": F.floor(F.col("total") / 2),
        })
        .where("total > 0")
    )
    middle = ranges.where(
        (F.col("before") <= F.col("mid_high")) & (F.col("before") + F.col("n") > F.col("mid_low"))
    ).select(group, "bucket", "before", "mid_low", "mid_high")

    # At most two rows per group: a proven bound for the broadcast.
    near = (
        counts.join(F.broadcast(middle), [group, "bucket"])
        .groupBy(group, "bucket", "value", "before", "mid_low", "mid_high")
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
    )
    in_range = (
        Window.partitionBy(group, "bucket")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    end = F.col("before") + F.sum("n").over(in_range)
    hits = near.withColumn("end", end).where(
        (F.col("end") - F.col("n") <= F.col("mid_high")) & (F.col("end") > F.col("mid_low"))
    )
    return hits.groupBy(group).agg(F.min("value").alias("low"), F.max("value").alias("high"))
