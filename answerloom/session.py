"""Session settings and the shared staging folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: str = "8", app: str = "answerloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters on which it is not installed."""
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="answerloom-package-")
    made = shutil.make_archive(f"{folder}/answerloom", "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(made)


def staging_dir(spark: SparkSession) -> str:
    """Folder every executor can see: the one the cluster names, else a fresh one in local mode."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="answerloom-")
    spark.conf.set(CHECKPOINT_DIR, made)
    return made


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table with several readers once and go on from the files.

    Unlike a cached table it survives lost executors, prunes columns and carries sizes Catalyst can
    use to choose joins.
    """
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that lies in fewer splits than there are cores over all of them.

    Tables with enough splits, which is every large one, are returned as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
