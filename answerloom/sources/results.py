"""Exports and saved evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Multi-line texts, quotes, outer spaces and empty strings survive a round trip with these.
CSV = {
    "header": True,
    "quoteAll": True,
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export(df: DataFrame, path: str, kind: str) -> None:
    """Write a table as csv, json or txt (one value per line; a table of one string column)."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.options(**CSV).csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "txt":
        writer.text(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)


def save_eval(nodes: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """One folder per node, as Parquet or CSV."""
    for name, rows in nodes.items():
        if kind == "parquet":
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            export(rows, f"{path}/{name}", kind)


def load_eval(spark: SparkSession, path: str, names: list[str], schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The saved nodes; CSV where ``schemas`` gives the columns of each."""
    if schemas:
        return {name: read_csv(spark, f"{path}/{name}", schemas[name]) for name in names}
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question) from a one-column list with a header line.

    Read as lines, since commas in such lists are not quoted; a byte order mark and carriage returns go.
    """
    line = F.regexp_replace("value", "^\ufeff|\r$", "")
    files = spark.read.text(path).select(
        line.alias("question"),
        (F.col("_metadata.file_block_start") == 0).alias("start"),
        F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_path").alias("file"),
    )
    # The header is the first line of its file; the same words further down are a question.
    headers = files.where("start and question = 'question'")
    first = files.where("start").groupBy("file").agg(F.min("at").alias("first"))
    header = headers.join(F.broadcast(first), "file").where("at = first").select("file", "at")
    rows = files.join(F.broadcast(header), ["file", "at"], "left_anti").select("question")
    unquoted = F.when(
        F.col("question").rlike('^".*"$'), F.regexp_replace(F.regexp_replace("question", '^"|"$', ""), '""', '"')
    ).otherwise(F.col("question"))
    return rows.where(F.trim("question") != "").select(unquoted.alias("question"))
