"""Scores of predicted answers against gold answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.ranking import round6
from answerloom.functions.skew import salted_join
from answerloom.functions.text import each, normal_answer, words


def answer_pairs(read: DataFrame, gold: DataFrame) -> DataFrame:
    """(q, rank, pred, gold): normalised predicted and gold answers of each query.

    ``read`` has at most n rows per query; "" stands for no answer on both sides.
    """
    answers = gold.select("q", normal_answer(F.coalesce("answer", F.lit(""))).alias("gold")).distinct()
    predicted = read.select("q", "rank", normal_answer(F.coalesce("answer", F.lit(""))).alias("pred"))
    return salted_join(answers, predicted, ["q"], ["gold"])


def overlap_f1(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``em`` and ``f1`` (bag-of-tokens overlap) to answer pairs.

    Token counts meet in a join on (pair, token). A pair is named by a hash of its gold answer, so long answers cost
    their length, not its square. Two empty answers agree; an empty and a full one do not.
    """
    key = [*by, "q", "rank", "gold_hash"]
    pairs = pairs.withColumn("gold_hash", F.md5(F.col("gold").cast("binary")))

    def bag(text: str, name: str) -> DataFrame:
        return (
            each(pairs, key, words(F.col(text)), "token").groupBy(*key, "token").agg(F.count("*").alias(name))
        )

    common = (
        bag("pred", "n_pred").join(bag("gold", "n_gold"), [*key, "token"])
        .groupBy(*key)
        .agg(F.sum(F.least("n_pred", "n_gold")).alias("common"))
    )
    n_pred, n_gold = F.size(words(F.col("pred"))), F.size(words(F.col("gold")))
    return (
        pairs.join(common, key, "left")
        .withColumn("em", (F.col("pred") == F.col("gold")).cast("double"))
        .withColumn(
            "f1",
            F.when((n_pred == 0) | (n_gold == 0), F.col("em")).otherwise(
                2.0 * F.coalesce("common", F.lit(0)) / (n_pred + n_gold)
            ),
        )
        .drop("common", "gold_hash")
    )


def prediction_scores(scored_pairs: DataFrame) -> DataFrame:
    """(q, rank, em, f1): best over the gold answers."""
    return scored_pairs.groupBy("q", "rank").agg(F.max("em").alias("em"), F.max("f1").alias("f1"))


def query_answer_scores(predictions: DataFrame, gold: DataFrame, n: int | None = None) -> DataFrame:
    """(q, em, f1): best of the first n predictions; queries without a prediction score 0."""
    kept = predictions if n is None else predictions.where(F.col("rank") <= n)
    best = kept.groupBy("q").agg(F.max("em").alias("em"), F.max("f1").alias("f1"))
    return (
        gold.select("q").distinct().join(best, "q", "left")
        .select("q", F.coalesce("em", F.lit(0.0)).alias("em"), F.coalesce("f1", F.lit(0.0)).alias("f1"))
    )


def pipeline_reader_metrics(scores: DataFrame) -> DataFrame:
    """exact_match and f1 as fractions."""
    means = scores.agg(round6(F.avg("em")).alias("exact_match"), round6(F.avg("f1")).alias("f1"))
    return means.unpivot([], ["exact_match", "f1"], "metric", "value")


def reader_eval(predictions: DataFrame, gold: DataFrame, n: int = 4) -> DataFrame:
    """Reader-alone metrics in percent, with and without no-answer queries.

    Accuracy counts a query as right if one of its first n predictions overlaps a gold answer. A query is a
    no-answer query if none of its gold answers has text.
    """
    has_text = gold.groupBy("q").agg(F.max((F.coalesce("answer", F.lit("")) != "").cast("int")).alias("text"))
    first = query_answer_scores(predictions, gold, 1).select(
        "q", F.col("em").alias("em1"), F.col("f1").alias("f11")
    )
    best = query_answer_scores(predictions, gold, n)
    rows = has_text.join(best, "q").join(first, "q")
    text_only = F.col("text") == 1
    right = (F.col("f1") > 0).cast("double")

    def pct(value, where=None):
        return round6(F.avg(value if where is None else F.when(where, value)) * 100)

    metrics = {
        "top_n_accuracy": pct(right),
        "EM": pct(F.col("em1")),
        "f1": pct(F.col("f11")),
        "top_n_accuracy_text_answer": pct(right, text_only),
        "top_n_EM_text_answer": pct(F.col("em"), text_only),
        "top_n_f1_text_answer": pct(F.col("f1"), text_only),
    }
    means = rows.agg(*[value.alias(name) for name, value in metrics.items()])
    return means.unpivot([], list(metrics), "metric", "value")
