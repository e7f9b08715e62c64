"""Small tabular analytics over an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def read_limited(spark: SparkSession, path: str, n: int, schema: str | None = None) -> DataFrame:
    """At most n rows of a CSV file, plain or gzipped."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader
    return reader.csv(path).limit(n)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def lowercase_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def parse_timestamp(text: Column, fmt: str | None = None) -> Column:
    """Timestamp, or null where the text is not one."""
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def hour_histogram(df: DataFrame, ts: str) -> DataFrame:
    """(hour, n): 24 bins, empty ones included."""
    counts = df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def filter_hour(df: DataFrame, ts: str, hour: int = 17) -> DataFrame:
    return df.where(F.hour(ts) == hour)


def keep_loaded(df: DataFrame) -> DataFrame:
    """Keep a table between interactions, in memory and on disk beyond it; the caller unpersists it."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
