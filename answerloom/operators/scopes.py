"""When does a retrieved document or a predicted answer count as correct?

Four answer scopes and six document scopes, each a boolean column over a row that pairs one prediction with
one gold label. Rows carry ``doc_key`` / ``gold_key`` (the document id, or any other field, e.g. the file
name), ``content`` / ``gold_context`` and ``answer``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.skew import salted_join
from answerloom.functions.text import let, word_ngrams

# Word n-gram length and share for a fuzzy context match.
NGRAM = 3
CONTAINMENT = 0.65

ANSWER_SCOPES = ["any", "context", "document_id", "document_id_and_context"]
DOCUMENT_SCOPES = [
    "document_id",
    "context",
    "document_id_and_context",
    "document_id_or_context",
    "answer",
    "document_id_or_answer",
]


def context_containment(a: Column, b: Column) -> Column:
    """Shared distinct word 3-grams over those of the shorter side."""
    return let(
        word_ngrams(a, NGRAM),
        lambda x: let(
            word_ngrams(b, NGRAM),
            lambda y: F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1)),
        ),
    )


def context_grams(text: Column) -> Column:
    """The distinct word n-grams of a context, as sorted hashes: made once per context, not once per pair."""
    return F.array_sort(F.transform(word_ngrams(text, NGRAM), lambda g: F.xxhash64(g)))


def context_shares(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """(q, rank, uid, share): each retrieved context beside each gold context of its query.

    A query has at most k retrieved contexts and any number of gold ones, which are dealt over salts. Both sides carry their n-grams
    as hashes.
    """
    x = retrieved.select("q", "rank", context_grams(F.col("content")).alias("x"))
    y = gold.select("q", "uid", context_grams(F.col("gold_context")).alias("y"))
    least = F.greatest(F.least(F.size("x"), F.size("y")), F.lit(1))
    return salted_join(y, x, ["q"], ["uid"]).select(
        "q", "rank", "uid", (F.size(F.array_intersect("x", "y")) / least).alias("share")
    )


def context_match(a: Column, b: Column) -> Column:
    """Fuzzy match of two contexts; a missing context never matches."""
    return F.coalesce(context_containment(a, b) >= CONTAINMENT, F.lit(False))


def id_match(a: Column, b: Column) -> Column:
    """Equal keys; a missing key never matches."""
    return F.coalesce(a == b, F.lit(False))


def answer_scope(scope: str, same_id: Column, same_context: Column) -> Column:
    return {
        "any": F.lit(True),
        "context": same_context,
        "document_id": same_id,
        "document_id_and_context": same_id & same_context,
    }[scope]


def document_scope(scope: str, same_id: Column, same_context: Column, holds_answer: Column) -> Column:
    """``holds_answer``: the text contains the answer and the chosen answer scope is met."""
    return {
        "document_id": same_id,
        "context": same_context,
        "document_id_and_context": same_id & same_context,
        "document_id_or_context": same_id | same_context,
        "answer": holds_answer,
        "document_id_or_answer": same_id | holds_answer,
    }[scope]


def scoped_pairs(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """(q, rank, gold_key, same_id, same_context, contains): each retrieved row beside each gold label.

    A query with very many labels is salted over them; ``retrieved`` has at most k rows per query.
    """
    rows = salted_join(
        gold.where(F.col("answer") != "").select("q", "answer", "gold_key", "gold_context"),
        retrieved.select("q", "rank", "doc_key", "content"),
        ["q"],
        ["answer", "gold_key"],
    )
    return rows.select(
        "q",
        "rank",
        "gold_key",
        id_match(F.col("doc_key"), F.col("gold_key")).alias("same_id"),
        context_match(F.col("content"), F.col("gold_context")).alias("same_context"),
        F.col("content").contains(F.col("answer")).alias("contains"),
    )


def scoped_relevance(pairs: DataFrame) -> DataFrame:
    """(answer_scope, document_scope, q, rank, gold_key, rel) for all 24 combinations."""
    same_id, same_context = F.col("same_id"), F.col("same_context")
    cases = [
        F.struct(
            F.lit(a).alias("answer_scope"),
            F.lit(d).alias("document_scope"),
            document_scope(
                d, same_id, same_context, F.col("contains") & answer_scope(a, same_id, same_context)
            ).cast("int").alias("rel"),
        )
        for a in ANSWER_SCOPES
        for d in DOCUMENT_SCOPES
    ]
    return pairs.select("q", "rank", "gold_key", F.explode(F.array(*cases)).alias("c")).select(
        "c.answer_scope", "c.document_scope", "q", "rank", "gold_key", "c.rel"
    )
