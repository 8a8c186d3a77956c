"""Logical events, users and products over the benchmark tables.

Each binding covers its tables whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Event types of the benchmark tables in terms of the engine's.
ORDER_STATUS_TYPES = {"O": "view", "F": "cart", "P": "purchase"}
CLICK_TYPES = {"click": "cart", "signup": "wishlist"}


@dataclass(frozen=True)
class Tables:
    events: DataFrame
    users: DataFrame
    products: DataFrame


# The columns in use. Declared, so that opening a table runs no job.
SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
              "o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT",
    "customer": "c_custkey BIGINT, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_type STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _renamed_types(col: Column, types: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(col == old, new) for old, new in types.items()], col)


def order_history(spark: SparkSession, sf_dir: str) -> Tables:
    """Customers as users, order lines as events by order status, parts as products.

    Segments by ``mktsegment`` and by part type.
    """
    orders = _table(spark, sf_dir, "orders")
    lines = _table(spark, sf_dir, "lineitem")
    events = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        _renamed_types(F.col("o_orderstatus"), ORDER_STATUS_TYPES).alias("event_type"),
        F.col("o_orderdate").alias("event_timestamp"),
    )
    users = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("mktsegment")
    )
    products = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category")
    )
    return Tables(events, users, products)


def gapped_order_history(spark: SparkSession, sf_dir: str) -> Tables:
    """``order_history`` whose dimensions have gaps and doubles.

    Customers of one segment have none, every customer is listed once more under ``ANY``,
    parts of one type have no category, and those of another are not in the table.
    """
    whole = order_history(spark, sf_dir)
    segment = F.when(F.col("mktsegment") != "MACHINERY", F.col("mktsegment"))
    users = whole.users.withColumn("mktsegment", segment).union(
        whole.users.select("user_id", F.lit("ANY"))
    )
    category = F.when(F.col("category") != "SMALL", F.col("category"))
    products = whole.products.where("category <> 'PROMO'").withColumn("category", category)
    return Tables(whole.events, users, products)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream by account, without device numbers."""
    return _table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        _renamed_types(F.col("event_type"), CLICK_TYPES).alias("event_type"),
        F.col("ts").alias("event_timestamp"),
    )


def text_clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clickstream`` with timestamps as text of a clock five and a half hours ahead."""
    ahead = F.col("event_timestamp") + F.make_dt_interval(hours=F.lit(5), mins=F.lit(30))
    text = F.concat(ahead.cast("string"), F.lit("+05:30"))
    return clickstream(spark, sf_dir).withColumn("event_timestamp", text)


# The clock of ``patterned_clickstream``.
CLOCK_PATTERN, CLOCK_ZONE = "dd.MM.yyyy, HH-mm-ss", "Asia/Kolkata"


def patterned_clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_clickstream``'s timestamps as texts of another pattern and clock."""
    ahead = F.col("ts") + F.make_dt_interval(hours=F.lit(5), mins=F.lit(30))
    told = F.date_format(ahead, CLOCK_PATTERN)
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        F.when(
            F.col("value") < 60,
            F.when(F.col("event_type") == "error", F.col("props")).otherwise(told),
        ).alias("event_timestamp"),
    )


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with one visitor per account and device number.

    By account alone every user has every event type and all rates are 1; the device
    number in ``props`` tells visitors apart and leaves no event out.
    """
    device = F.get_json_object("props", "$.k")
    return _table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), device).alias("user_id"),
        _renamed_types(F.col("event_type"), CLICK_TYPES).alias("event_type"),
        F.col("ts").alias("event_timestamp"),
    )


def raw_clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a log with delivery faults, timestamps as text.

    Sign-ups have a blank user, events worth less than 1 no type, those worth less than
    2 an empty one, those worth 60 or more no timestamp, and the timestamps of errors
    hold their payload.
    """
    value = F.col("value")
    kind = _renamed_types(F.col("event_type"), CLICK_TYPES)
    return _table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "signup", "  ")
        .otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(value >= 2, kind).when(value >= 1, "").alias("event_type"),
        F.when(value < 60, F.when(F.col("event_type") == "error", F.col("props"))
               .otherwise(F.col("ts").cast("string"))).alias("event_timestamp"),
    )
