"""Input tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from anbar.config import PERSIAN_TO_CANONICAL

CALENDAR_SCHEMA = "Date string, WorkingDay int"

#: One header text per column.
PERSIAN_HEADERS = tuple({v: k for k, v in PERSIAN_TO_CANONICAL.items()}.values())


def text_columns(names: Sequence[str] = PERSIAN_HEADERS) -> StructType:
    """A schema of text columns: the given names, or one Persian header for each column."""
    return StructType([StructField(n, StringType()) for n in names])


def read_transactions(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    **options,
) -> DataFrame:
    """Stock document lines from parquet, ORC, CSV or JSON, header texts stripped.

    A ``seq`` row number is added when the input has none; label codes follow it. It
    grows with the read order and is the same on a retried task. For a defined order
    over many files, give the input its own ``seq`` column.

    Text formats are never read by inference, which would scan the data twice and guess
    types: CSV without a schema is read as text by its header, JSON needs a schema (see
    ``text_columns``).
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is None and fmt == "json":
        raise ValueError("JSON needs a schema, for example text_columns()")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.monotonically_increasing_id())
    return df


def read_working_days(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Working-day calendar from CSV with a header; a malformed date raises."""
    return parse_working_days(spark.read.csv(path, header=True, schema=CALENDAR_SCHEMA))


def parse_working_days(calendar: DataFrame) -> DataFrame:
    """(Date ``dd/mm/yyyy``, WorkingDay) to (gregorian_date, working_day)."""
    return calendar.select(
        F.to_date("Date", "d/M/yyyy").alias("gregorian_date"),
        F.col("WorkingDay").cast("int").alias("working_day"),
    )
