"""Graded similarity of predicted and gold answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerloom.functions.ranking import round6
from answerloom.functions.skew import lookup_document_frequency
from answerloom.functions.text import each, tokens
from answerloom.operators.terms import smooth_idf


def lexical_similarity(pairs: DataFrame, frequencies: DataFrame, n_units) -> DataFrame:
    """(key, similarity): TF-IDF cosine of the texts ``a`` and ``b`` of each pair.

    The default where no model is given; a cross-encoder plugs in through ``generate.apply_model``.
    """
    both = pairs.select("key", F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(side).alias("text")) for side in ("a", "b")
    ])).alias("x")).select("key", "x.side", "x.text")
    counts = each(both, ["key", "side"], tokens(F.col("text")), "t").groupBy("key", "side", "t").agg(
        F.count("*").alias("tf")
    )
    known = lookup_document_frequency(counts.select("t").distinct(), frequencies, n_units)
    weighted = counts.join(known, "t", "left").withColumn(
        "w", F.col("tf") * (smooth_idf(n_units, F.coalesce("df", F.lit(0))) + 1)
    )
    unit = F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key", "side")))
    scaled = weighted.select("key", "side", "t", unit.alias("w"))
    per_term = scaled.groupBy("key", "t").agg(
        F.count("*").alias("sides"), F.max("w").alias("hi"), F.min("w").alias("lo")
    )
    cosine = per_term.where(F.col("sides") == 2).groupBy("key").agg(F.sum(F.col("hi") * F.col("lo")).alias("s"))
    return pairs.select("key").join(cosine, "key", "left").select(
        "key", round6(F.coalesce("s", F.lit(0.0))).alias("similarity")
    )
