"""Documents arriving as files: split and turned into question/answer pairs as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.operators.generate import Statistics, statistics_of
from answerloom.sources.manifest import Versioned


def uploaded_texts(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of (name, content), one row per new text file."""
    stream = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return stream.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("content")
    )


def uploaded_tables(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of the rows of a Parquet table, one file or a folder to which files are added."""
    # As a pattern the path may be a file: only plain paths have to be folders.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def process_available(
    stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> DataFrame:
    """Run a stateless step over everything that has arrived, append to ``out`` and return it as a table.

    The checkpoint remembers the files taken, so a later call adds only new ones, also after a failure.
    """
    made = step(stream)
    query = (
        made.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(made.schema).parquet(out)


class StatisticsStore(Versioned):
    """Snapshots of a corpus' document frequencies. A stream asks its questions with one of them, so what it makes does not
    depend on which files have arrived, nor on a snapshot that is taken meanwhile."""

    def take(self, documents: DataFrame) -> int:
        """Store the statistics of (doc_id, text) as the next version, and return its number."""
        frequencies, n = statistics_of(documents)
        return self._commit({"n": n, "frequencies": self._write(frequencies)}, (self.versions() or [-1])[-1])

    def statistics(self, version: int | None = None) -> Statistics:
        manifest = self.manifest(version)
        return self.spark.read.parquet(f"{self.path}/{manifest['frequencies']}"), manifest["n"]


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """What ``pairs_per_batch`` has written, without the numbers of the batches."""
    return spark.read.parquet(out).drop("batch")


def pairs_per_batch(
    stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> None:
    """Like ``process_available`` for steps that aggregate within a batch, e.g. question generation.

    Each micro-batch writes to a folder of its own number, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
