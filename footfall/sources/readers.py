"""Readers for the event log, its dimensions and the written results.

CSV is read with the names of its header line and every column declared as text, Parquet
with its own types. CSV is accepted for small extracts; Parquet is the format for large
logs, where the engine's filters and column choices reach the file scan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from footfall import schema
from footfall.functions.times import parsed_timestamp, utc_time
from footfall.operators import quality
from footfall.sources.publication import published
from footfall.sources.records import parsed, records


class MissingArtifact(FileNotFoundError):
    """A result table was asked for that no run has written."""


# Prefix of the error raised for a timestamp that does not parse.
INVALID_TIMESTAMP = "event_timestamp does not parse: "

# Columns that no metric uses.
OPTIONAL = {"event_id"}

# CSV texts that stand for a missing value.
CSV_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# How result tables and extracts are written: quotes are doubled, blanks are kept.
CSV_FORM = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All columns as text. Every record is checked against the whole header line,
    whichever columns are read."""
    reader = spark.read.options(**CSV_FORM, mode="FAILFAST", multiLine=multi_line)
    names = reader.csv(path).columns
    if multi_line:
        return parsed(records(spark, path), names, CSV_FORM)
    declared = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return reader.options(columnPruning=False, enforceSchema=False).schema(declared).csv(path)


def _read(
    spark: SparkSession, path: str, columns: T.StructType, fmt: str, multi_line: bool = False
) -> DataFrame:
    """The declared columns by name, in any order and among any others.

    CSV columns are text; Parquet columns keep their own types, so numeric ids stay
    numeric. ``multi_line`` is for CSV with line breaks in quotes, see
    ``sources.records``.
    """
    if fmt == "csv":
        table = _csv(spark, path, multi_line)
    elif fmt == "parquet":
        table = spark.read.parquet(path)
    else:
        raise ValueError(f"format must be 'csv' or 'parquet', not {fmt!r}")
    absent = set(columns.names) - set(table.columns)
    if absent - OPTIONAL:
        raise ValueError(f"{path} lacks the columns {sorted(absent - OPTIONAL)}")
    names = [name for name in columns.names if name not in absent]
    if fmt == "csv":
        return table.select(*[
            F.when(~F.col(name).isin(*CSV_NULLS), F.col(name)).alias(name) for name in names
        ])
    return table.select(*names)


def parse_timestamps(
    raw_events: DataFrame, pattern: str | None = None, zone: str = "UTC"
) -> DataFrame:
    """Turn text timestamps into TIMESTAMP_NTZ in UTC; text that does not parse fails the job.

    ``pattern`` is a datetime pattern; without one, ISO texts are read. A text with a UTC
    offset or a zone of its own is taken at its word; any other is a time of ``zone``. An
    absent timestamp stays NULL. Neither the session's ANSI mode nor its zone matters.
    """
    text = F.col("event_timestamp")
    error = F.raise_error(F.concat(F.lit(INVALID_TIMESTAMP), text))
    parsed = F.coalesce(parsed_timestamp(text, pattern, zone), F.when(text.isNotNull(), error))
    return raw_events.withColumn("event_timestamp", parsed)


def prepare_events(table: DataFrame, pattern: str | None = None, zone: str = "UTC") -> DataFrame:
    """Bring the timestamp of any event table to TIMESTAMP_NTZ.

    Instants (TIMESTAMP) become UTC times, whatever the session's zone.
    """
    kind = table.schema["event_timestamp"].dataType
    if isinstance(kind, T.StringType):
        return parse_timestamps(table, pattern, zone)
    if isinstance(kind, T.TimestampNTZType):
        return table
    return table.withColumn("event_timestamp", utc_time(F.col("event_timestamp")))


def read_raw_events(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """The log as delivered, timestamps as text: input of ``quality.bad_timestamps``."""
    raw = _read(spark, path, schema.EVENTS, fmt, multi_line)
    return raw.withColumn("event_timestamp", F.col("event_timestamp").cast("string"))


def read_events(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    multi_line: bool = False,
    pattern: str | None = None,
    zone: str = "UTC",
) -> DataFrame:
    """The log with parsed timestamps; ``pattern`` and ``zone`` as in ``parse_timestamps``."""
    return prepare_events(_read(spark, path, schema.EVENTS, fmt, multi_line), pattern, zone)


def read_split_events(
    spark: SparkSession,
    path: str,
    quarantine: str,
    fmt: str = "csv",
    multi_line: bool = False,
    pattern: str | None = None,
    zone: str = "UTC",
) -> tuple[DataFrame, DataFrame]:
    """(good rows, counts): bad rows go to a Parquet table instead of failing the job.

    The log is judged once. Its bad rows are written to ``quarantine``, with their reasons,
    and taken from the good ones; ``quality.quarantine_counts`` tells how many there are. Rows
    of good and bad together are the rows of the log.
    """
    raw = read_raw_events(spark, path, fmt, multi_line)
    judged = quality.judged(raw, pattern=pattern, zone=zone)
    quality.quarantined(judged).write.mode("overwrite").parquet(quarantine)
    return quality.good_events(judged), quality.quarantine_counts(judged)


def read_users(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    attribute: str = "gender",
    multi_line: bool = False,
) -> DataFrame:
    columns = T.StructType([schema.USERS["user_id"], T.StructField(attribute, T.StringType())])
    return _read(spark, path, columns, fmt, multi_line)


def read_products(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    return _read(spark, path, schema.PRODUCTS, fmt, multi_line)


def read_artifact(spark: SparkSession, out_dir: str, name: str, fmt: str = "csv") -> DataFrame:
    """A result table by name, with its declared types.

    Of a folder that the batch job published to, the table of its last whole run, in that run's
    format; else the table that was written to the folder itself. Raises ``MissingArtifact``
    where it has not been written.
    """
    if name not in schema.ARTIFACTS:
        raise MissingArtifact(f"no such artifact: {name!r}; known: {sorted(schema.ARTIFACTS)}")
    _, run = published(spark, out_dir)
    if run is not None and name in run["tables"]:
        out_dir, fmt = f"{out_dir}/{run['folder']}", run["format"]
    reader = spark.read.schema(schema.ARTIFACTS[name]).format(fmt)
    if fmt == "csv":
        # An empty field is NULL and a quoted empty one a text: NULL gets a sign no text has.
        reader = reader.options(**CSV_FORM, mode="FAILFAST", multiLine=True, nullValue="\x00")
    try:
        return reader.load(f"{out_dir}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingArtifact(
            f"artifact {name!r} is not in {out_dir}; run the batch job first"
        ) from error
