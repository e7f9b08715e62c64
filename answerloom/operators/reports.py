"""Reports over metric tables (run, node, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.ranking import round6


def worst_queries(scores: DataFrame, results: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """The n queries with the lowest score, with what was returned for them; a query without results has one row of
    nulls."""
    worst = scores.orderBy(F.asc(metric), F.asc("q")).limit(n).select("q", metric)
    found = results.join(F.broadcast(worst.select("q")), "q", "left_semi")
    return worst.join(found, "q", "left")


def compare_runs(metrics: DataFrame, before: str, after: str) -> DataFrame:
    """One row per node and metric: both values and their difference."""
    wide = metrics.groupBy("node", "metric").pivot("run", [before, after]).agg(F.first("value"))
    return wide.withColumn("delta", round6(F.col(after) - F.col(before)))


def score_table(metrics: DataFrame) -> DataFrame:
    """(Metrics, Score) in percent, for plotting."""
    return metrics.select(F.col("metric").alias("Metrics"), round6(F.col("value") * 100).alias("Score"))


def isolated_gap(integrated: DataFrame, isolated: DataFrame) -> DataFrame:
    """Reader metrics on retrieved and on gold documents; a large gap points at the retriever."""
    a = integrated.select("metric", F.col("value").alias("integrated"))
    b = isolated.select("metric", F.col("value").alias("isolated"))
    return a.join(b, "metric", "full_outer").withColumn("gap", round6(F.col("isolated") - F.col("integrated")))
