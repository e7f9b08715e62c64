"""Scores of retrieved rows against gold labels.

Relevance tables are (q, rank, rel) with ``rel`` 0 or 1; extra leading columns (``by``) score several
variants at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.functions.ranking import round6
from answerloom.functions.skew import salted_join


def mark_relevant(retrieved: DataFrame, labels: DataFrame, match: Column | None = None) -> DataFrame:
    """(q, rank, rel): open-domain rule, a retrieved text is relevant if it contains a gold answer.

    ``retrieved`` holds at most k rows per query; a query with very many labels is salted over them.
    """
    answers = labels.where(F.col("answer") != "").groupBy("q", "answer").agg(F.count("*").alias("copies"))
    hit = F.col("content").contains(F.col("answer")) if match is None else match
    hits = (
        salted_join(answers, retrieved.select("q", "rank", "content"), ["q"], ["answer"])
        .groupBy("q", "rank")
        .agg(F.max(hit.cast("int")).alias("rel"))
    )
    asked = labels.select("q").distinct()
    return (
        retrieved.join(asked, "q", "left_semi")
        .join(hits, ["q", "rank"], "left")
        .select("q", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))
    )


def query_scores(relevance: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per query: recall_single_hit, mrr, precision and map.

    Average precision divides by the relevant rows retrieved. A group holds the k rows of one query.
    """
    keys = [*by, "q"]
    numbered = relevance.withColumn(
        "hit_no", F.sum("rel").over(Window.partitionBy(*keys).orderBy("rank"))
    )
    first = F.min(F.when(F.col("rel") == 1, F.col("rank")))
    at_hits = F.avg(F.when(F.col("rel") == 1, F.col("hit_no") / F.col("rank")))
    return numbered.groupBy(*keys).agg(
        F.max("rel").cast("double").alias("recall_single_hit"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"),
        (F.sum("rel") / F.count("*")).alias("precision"),
        F.coalesce(at_hits, F.lit(0.0)).alias("map"),
    )


def mean_scores(scores: DataFrame, metrics: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, metric, value): means over queries, one row per metric."""
    means = scores.groupBy(*by).agg(*[round6(F.avg(m)).alias(m) for m in metrics])
    return means.unpivot(list(by), metrics, "metric", "value")


def recall_multi_hit(gold_hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, q, recall_multi_hit) from (q, gold document, hit): share of the gold documents retrieved."""
    return gold_hits.groupBy(*by, "q").agg(F.avg(F.col("hit").cast("double")).alias("recall_multi_hit"))


def gold_document_hits(retrieved: DataFrame, labels: DataFrame) -> DataFrame:
    """(q, uid, hit) per gold document."""
    gold = labels.where(F.col("uid").isNotNull()).select("q", "uid").distinct()
    found = retrieved.select("q", "uid").distinct().withColumn("found", F.lit(1))
    return gold.join(found, ["q", "uid"], "left").select("q", "uid", F.coalesce("found", F.lit(0)).alias("hit"))
