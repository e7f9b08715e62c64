"""Training data made from generated questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.ranking import round6
from answerloom.functions.skew import salted_join
from answerloom.operators.sparse import Bm25
from answerloom.session import stage


def hard_pairs(pairs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Pairs that a reviewer changed: the corrected ones teach more than those already right."""
    fixed = corrections.select("id", F.col("answer").alias("corrected"))
    return (
        pairs.join(fixed, "id", "left")
        .withColumn("final", F.coalesce("corrected", "answer"))
        .where(F.col("final") != F.col("answer"))
        .select("id", "question", F.col("answer").alias("wrong_answer"), F.col("final").alias("answer"))
    )


def split_of(key: Column, eval_percent: int = 20) -> Column:
    """"eval" or "train" by a hash of the key: one query never lands in both."""
    bucket = F.conv(F.substring(F.md5(key.cast("binary")), 1, 6), 16, 10).cast("bigint") % 100
    return F.when(bucket < eval_percent, "eval").otherwise("train")


def split_train_eval(labels: DataFrame, key: str = "query", eval_percent: int = 20) -> DataFrame:
    return labels.withColumn("part", split_of(F.col(key), eval_percent))


def pseudo_labels(asked: DataFrame, units: DataFrame) -> DataFrame:
    """(q, pos_uid, pos_score, neg_uid, neg_score, margin) from questions (q, uid, query) made from units.

    The negative is the best other unit by BM25. A question made from many copies of a unit is asked once: its
    two best units hold the best other one for each of them. Beside them only the units it was made from are scored.
    """
    search = Bm25(asked.select("q", "query").distinct(), units)
    best = stage(search.topk(2), "best").select(
        "q", F.col("uid").alias("neg_uid"), F.col("score").alias("neg_score"), "rank"
    )
    sources = asked.select("q", F.col("uid").alias("pos_uid"))
    scores = search.scores_of(asked.select("q", "uid"))
    positive = scores.withColumnRenamed("uid", "pos_uid").join(sources, ["q", "pos_uid"]).select(
        "q", "pos_uid", F.col("score").alias("pos_score")
    )
    others = salted_join(sources, best, ["q"], ["pos_uid"]).where(F.col("neg_uid") != F.col("pos_uid"))
    negative = others.groupBy("q", "pos_uid").agg(
        F.min(F.struct("rank", "neg_uid", "neg_score")).alias("n")
    ).select("q", "pos_uid", "n.neg_uid", "n.neg_score")
    return positive.join(negative, ["q", "pos_uid"], "left").withColumn(
        "margin", round6(F.col("pos_score") - F.coalesce("neg_score", F.lit(0.0)))
    )
