"""Answer extraction from retrieved passages.

``retrieved`` rows are (q, query, uid, content, ...), at most top-k per query. A sentence is scored by the
inverse document frequencies of the distinct terms it shares with the query, over the square root of its
length in words. ``top_n`` spans per query are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.ranking import ln_ratio, round6, top_k
from answerloom.functions.skew import fits_broadcast, salted_join
from answerloom.functions.text import aligned_terms, each, sentences, word_terms, words


def query_idf(queries: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """(q, terms): the distinct terms of a query with their idf, in term order."""
    asked = each(queries, ["q"], F.array_distinct(word_terms(F.col("query"))), "t")
    fits = fits_broadcast(asked)
    vocabulary = asked.select("t").distinct()
    seen = each(documents, ["doc_id"], F.array_distinct(word_terms(F.col(text))), "t")
    kept = salted_join(seen, vocabulary, ["t"], ["doc_id"], how="left_semi", fits=fits)
    df = kept.groupBy("t").agg(F.count("*").alias("df"))
    n = documents.agg(F.count("*")).scalar()
    return (
        salted_join(asked, df, ["t"], ["q"], how="left", fits=fits)
        .groupBy("q")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("t", ln_ratio(n + 1, F.coalesce("df", F.lit(0)) + 1).alias("idf")))
            ).alias("terms")
        )
    )


def candidate_spans(retrieved: DataFrame, idf: DataFrame) -> DataFrame:
    """(q, uid, sent, answer, start, score): every sentence of the retrieved texts that shares a term."""
    spans = each(retrieved, ["q", "uid", "content"], sentences(F.col("content")), "answer", "sent")
    # A sentence is placed where its text is at hand, so the text of a passage is not sent with each of its sentences.
    start = F.instr(F.col("content"), F.col("answer")) - 1
    spans = spans.select("q", "uid", "sent", "answer", start.alias("start"), aligned_terms(words(F.col("answer"))).alias("own"))
    shared = F.filter("terms", lambda x: F.array_contains(F.col("own"), x["t"]))
    # A query may be given any number of passages: its spans are dealt over salts, and cut to the best before they meet.
    scored = (
        salted_join(spans, idf, ["q"], ["uid", "sent"])
        .withColumn(
            "score",
            round6(
                F.aggregate(shared, F.lit(0.0), lambda a, x: a + x["idf"])
                / F.sqrt(F.greatest(F.size("own"), F.lit(1)).cast("double"))
            ),
        )
    )
    return scored.where(F.col("score") > 0).select("q", "uid", "sent", "answer", "start", "score")


def extract_answers(retrieved: DataFrame, idf: DataFrame, top_n: int = 4) -> DataFrame:
    spans = candidate_spans(retrieved, idf)
    return top_k(spans, ["q"], [F.desc("score"), F.asc("uid"), F.asc("sent")], top_n)


def with_no_answer(
    spans: DataFrame, queries: DataFrame, threshold: float, boost: float = 0.0, top_n: int = 4
) -> DataFrame:
    """Let "no answer" compete with score ``threshold + boost``; it loses ties."""
    none = queries.select(
        "q",
        F.lit(None).cast("string").alias("uid"),
        F.lit(None).cast("int").alias("sent"),
        F.lit(None).cast("string").alias("answer"),
        F.lit(None).cast("int").alias("start"),
        round6(F.lit(threshold + boost)).alias("score"),
    )
    order = [F.desc("score"), F.asc_nulls_last("uid"), F.asc_nulls_last("sent")]
    return top_k(spans.unionByName(none), ["q"], order, top_n)
