"""Strict cart -> purchase conversion by slice of the users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from footfall.functions.rates import percent, ratio

# Columns of the output table.
COLUMNS = (
    "segment_type",
    "segment_value",
    "cart_users",
    "purchased",
    "cart_to_purchase_conversion",
    "cart_to_purchase_conversion_pct",
)


def _conversion(members: DataFrame, segment_type: str) -> DataFrame:
    """``members`` has one row per user and segment value."""
    rate = F.col("cart_to_purchase_conversion")
    return (
        members.groupBy("segment_value")
        .agg(
            F.count("*").alias("cart_users"),
            F.count_if("has_purchase").alias("purchased"),
        )
        .withColumn("segment_type", F.lit(segment_type))
        .withColumn("cart_to_purchase_conversion", ratio(F.col("purchased"), F.col("cart_users")))
        .withColumn("cart_to_purchase_conversion_pct", percent(rate))
        .select(*COLUMNS)
    )


def segment_by_attribute(
    flags: DataFrame, users: DataFrame, attribute: str = "gender", keep_null: bool = False
) -> DataFrame:
    """Conversion per value of a user attribute.

    A user listed with two values counts in both; users without a value are left out
    unless ``keep_null``. ``flags`` is ``user_flags`` or ``user_facts``.
    """
    cart_users = flags.where("has_cart").select("user_id", "has_purchase")
    # Both sides are one row per user, so the join needs no shuffle beyond theirs.
    values = users.groupBy("user_id").agg(
        F.collect_set(attribute).alias("values"), F.bool_or(F.col(attribute).isNull()).alias("none")
    )
    each = F.col("values")
    if keep_null:
        nothing = F.array(F.lit(None).cast(users.schema[attribute].dataType))
        each = F.when(F.col("none"), F.concat("values", nothing)).otherwise(each)
    members = cart_users.join(values, "user_id").select(
        "user_id", "has_purchase", F.explode(each).alias("segment_value")
    )
    return _conversion(members, attribute)


def primary_category(
    events: DataFrame, products: DataFrame, eager: bool = False
) -> DataFrame:
    """``user_id, primary_cart_category``: the category a user carted most often.

    Ties go to the category carted first, then to the first in the alphabet. Carts of
    unknown products count for no category; users with only such carts are left out.

    The product join carries no broadcast hint: Spark broadcasts the table when its
    measured size is below the session's threshold and otherwise shuffles by product,
    where adaptive execution splits the partition of a hot product.

    ``eager`` counts carts by user and product before that join, so that it gets one row for each
    user and product, however often the user carted it. That is one more shuffle, of those rows;
    it pays where users cart the same products many times and the table of products is too
    large to be broadcast. The caller chooses; the result is the same.
    """
    carts = events.where(
        (F.col("event_type") == "cart") & F.col("user_id").isNotNull()
    ).select("user_id", "product_id", "event_timestamp")
    categories = products.where(F.col("category").isNotNull()).select("product_id", "category")
    first, count = F.min("event_timestamp"), F.count("*")
    if eager:
        known = carts.where(F.col("product_id").isNotNull())
        carts = known.groupBy("user_id", "product_id").agg(
            count.alias("n"), first.alias("event_timestamp")
        )
        count = F.sum("n")
    per_category = (
        carts.join(categories, "product_id")
        .groupBy("user_id", "category")
        .agg(count.alias("cnt"), first.alias("first_ts"))
    )
    best_first = Window.partitionBy("user_id").orderBy(
        F.desc("cnt"), F.asc_nulls_last("first_ts"), F.asc("category")
    )
    return (
        per_category.withColumn("rn", F.row_number().over(best_first))
        .where("rn = 1")
        .select("user_id", F.col("category").alias("primary_cart_category"))
    )


def segment_by_primary_category(flags: DataFrame, primary: DataFrame) -> DataFrame:
    """Conversion per ``primary_category``."""
    members = flags.where("has_cart").select("user_id", "has_purchase").join(primary, "user_id")
    return _conversion(
        members.withColumnRenamed("primary_cart_category", "segment_value"),
        "primary_cart_category",
    )


def segment_conversion(by_attribute: DataFrame, by_category: DataFrame) -> DataFrame:
    """Both segment types in one table, largest segments first."""
    return by_attribute.unionByName(by_category).orderBy(
        F.asc("segment_type"), F.desc("cart_users"), F.asc("segment_value")
    )


def segment_spread(segments: DataFrame) -> DataFrame:
    """Gap in percentage points between the best and the worst segment of each type."""
    pct = F.col("cart_to_purchase_conversion_pct")
    return segments.groupBy("segment_type").agg(
        F.min(pct).alias("min_pct"),
        F.max(pct).alias("max_pct"),
        F.bround(F.max(pct) - F.min(pct), 2).alias("spread_pp"),
    )


def top_segments(
    segments: DataFrame, k: int = 10, segment_type: str = "primary_cart_category"
) -> DataFrame:
    """The ``k`` best converting segments of a type."""
    return (
        segments.where(F.col("segment_type") == segment_type)
        .select("segment_value", "cart_users", "cart_to_purchase_conversion_pct")
        .orderBy(F.desc("cart_to_purchase_conversion_pct"), F.asc("segment_value"))
        .limit(k)
    )


def segment_types(segments: DataFrame) -> DataFrame:
    """The segment types present, sorted."""
    return segments.select("segment_type").distinct().orderBy("segment_type")
