"""Routing queries to branches and merging what the branches return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.functions.ranking import round6, top_k


def route(query: Column) -> Column:
    """Queries with a question mark go to branch 2, keyword queries to branch 1."""
    return F.when(query.contains("?"), F.lit(2)).otherwise(F.lit(1))


def route_queries(df: DataFrame, query: str = "query") -> tuple[DataFrame, DataFrame]:
    return df.where(route(F.col(query)) == 1), df.where(route(F.col(query)) == 2)


def merge_by_score(branches: list[DataFrame]) -> DataFrame:
    """Union of retrieved rows (q, uid, score); a unit found twice keeps its best score."""
    return _union(branches).groupBy("q", "uid").agg(F.max("score").alias("score"))


def merge_by_rank(branches: list[DataFrame], c: int = 60, k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion, for branches whose scores have different scales."""
    fused = (
        _union(branches)
        .groupBy("q", "uid")
        .agg(round6(F.sum(1.0 / (F.col("rank") + F.lit(c)))).alias("score"))
    )
    return fused if k is None else top_k(fused, ["q"], [F.desc("score"), F.asc("uid")], k)


def join_answers(branches: list[DataFrame], sort_by_score: bool = True) -> DataFrame:
    """Answers of several nodes, each (q, answer, score, rank); answers without a score go last.

    ``position`` is the place among all answers of the query, of which each node returns only its top few.
    """
    tagged = _union([b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)])
    by_score = [F.desc_nulls_last("score"), F.asc("branch"), F.asc("rank")]
    order = by_score if sort_by_score else [F.asc("branch"), F.asc("rank")]
    return tagged.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy(*order)))


def filter_query(results: DataFrame, query: str) -> DataFrame:
    return results.where(F.col("query") == query)


def head(results: DataFrame, n: int = 5) -> DataFrame:
    """First rows of a node's result, in a fixed order."""
    return results.orderBy("q", "rank").limit(n)


def _union(branches: list[DataFrame]) -> DataFrame:
    first, *others = branches
    for other in others:
        first = first.unionByName(other)
    return first
