"""Named indexes as Parquet folders, and loading a corpus into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_corpus(spark: SparkSession, path: str, meta: dict[str, str] | None = None) -> DataFrame:
    """One document per text file: (name, content, content_type, meta)."""
    files = spark.read.text(path, wholetext=True)
    pairs = [x for k, v in (meta or {}).items() for x in (F.lit(k), F.lit(v))]
    return files.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"),
        F.col("value").alias("content"),
        F.lit("text").alias("content_type"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("meta"),
    )


def write_index(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def upsert(index: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace rows with the same key. Write the result to a new folder.

    Where ``new`` repeats a key, the row with the largest ``order`` is the last write and wins; rows with equal
    order, or without an order column, are told apart by their content, so the result is the same each time.
    """
    content = F.struct(*[c for c in new.columns if c not in (key, order)])
    by = F.struct(F.col(order), content) if order else content
    latest = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), by).alias("_row"))
    latest = latest.select(key, "_row.*").select(*[c for c in new.columns if c in index.columns])
    return index.join(latest.select(key), key, "left_anti").unionByName(latest)


def delete_documents(spark: SparkSession, path: str) -> None:
    """Clear an index; its schema stays."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def remaining(index: DataFrame, doomed) -> DataFrame:
    """Index without the rows a filter selects, to be written to a new folder; rows with a null filter stay."""
    return index.where(~F.coalesce(doomed, F.lit(False)))


def scan(spark: SparkSession, path: str, excluded: tuple[str, ...] = ("emb",)) -> DataFrame:
    """All documents without the excluded fields, which are then not read either."""
    return spark.read.parquet(path).drop(*excluded)


def first_document(index: DataFrame, key: str = "id") -> DataFrame:
    return index.orderBy(key).limit(1)
