"""Gold labels: building them from known passages and grouping them per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.ranking import top_k
from answerloom.functions.skew import fits_broadcast, salted_join
from answerloom.functions.text import each, words


def find_verbatim(items: DataFrame, units: DataFrame) -> DataFrame:
    """(q, uid) for every item (q, answer) that occurs verbatim in a unit (uid, content).

    A text that contains an item contains its inner words as whole words, so items of three or more
    words meet the units on one inner word, the rarest in the units; shorter items meet them on the first
    characters of their longest word. Both are equi-joins; ``contains`` then checks the few pairs.
    """
    split_items = items.select("q", "answer", words(F.col("answer")).alias("ws"))
    by_word = _match_on_inner_word(split_items.where(F.size("ws") >= 3), units)
    short = split_items.where((F.size("ws") < 3) & (F.size("ws") > 0))
    return by_word if short.isEmpty() else by_word.unionByName(_match_on_word_part(short, units))


def _match_on_inner_word(items: DataFrame, units: DataFrame) -> DataFrame:
    """Few items: their words are broadcast, and no text of a unit leaves the task that reads it."""
    inner = each(items, ["q"], F.array_distinct(F.slice("ws", 2, F.size("ws") - 2)), "anchor")
    fits = fits_broadcast(inner)
    distinct_words = F.array_distinct(words(F.col("content")))
    unit_words = each(units, ["uid"], distinct_words, "anchor")
    found = salted_join(unit_words, inner.select("anchor").distinct(), ["anchor"], ["uid"], how="left_semi", fits=fits)
    counts = found.groupBy("anchor").agg(F.count("*").alias("df"))
    known = salted_join(inner, counts, ["anchor"], ["q"], fits=fits)
    rarest = top_k(known, ["q"], [F.asc("df"), F.asc("anchor")], 1)
    anchored = rarest.select("q", "anchor").join(items.select("q", "answer"), "q")
    if fits:
        texts = each(units, ["uid", "content"], distinct_words, "anchor")
        pairs = texts.join(F.broadcast(anchored), "anchor")
        return pairs.where(F.col("content").contains(F.col("answer"))).select("q", "uid")
    return _verified(salted_join(found, anchored, ["anchor"], ["uid"]), units)


def _match_on_word_part(items: DataFrame, units: DataFrame) -> DataFrame:
    longest = F.array_max(F.transform("ws", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    anchored = items.select("q", "answer", F.substring(longest, 1, 3).alias("anchor"))

    def parts(ws: Column) -> Column:
        def of_word(w: Column) -> Column:
            starts = F.sequence(F.lit(1), F.length(w))
            return F.flatten(
                F.transform(starts, lambda i: F.array(*[F.substring(w, i, F.lit(n)) for n in (1, 2, 3)]))
            )

        return F.array_distinct(F.flatten(F.transform(F.array_distinct(ws), of_word)))

    unit_parts = each(units, ["uid"], parts(words(F.col("content"))), "anchor")
    return _verified(salted_join(unit_parts, anchored, ["anchor"], ["uid"]), units)


def _verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    return pairs.join(units, "uid").where(F.col("content").contains(F.col("answer"))).select("q", "uid")


def label_rows(items: DataFrame, matches: DataFrame) -> DataFrame:
    """One label per (item, unit); an item found nowhere gets one no-answer label."""
    return items.join(matches, "q", "left").select(
        "q",
        "query",
        F.when(F.col("uid").isNull(), "").otherwise(F.col("answer")).alias("answer"),
        "uid",
        F.lit(True).alias("is_correct_answer"),
        F.col("uid").isNotNull().alias("is_correct_document"),
        F.lit("gold-label").alias("origin"),
    )


def labels_aggregated(
    labels: DataFrame, drop_negative_labels: bool = True, drop_no_answers: bool = True
) -> DataFrame:
    """(q, query, uid, answers, n_labels): the labels of a query, one row per query and document.

    Equal labels are merged before the shuffle. Collecting per document rather than per query keeps each
    list within the answer spans of one document, however many labels a query has.
    """
    kept = labels
    if drop_negative_labels:
        kept = kept.where(F.col("is_correct_answer"))
    if drop_no_answers:
        kept = kept.where(F.col("answer") != "")
    distinct = kept.groupBy("q", "query", "uid", "answer").agg(F.count("*").alias("copies"))
    return distinct.groupBy("q", "query", "uid").agg(
        F.sort_array(F.collect_list("answer")).alias("answers"), F.sum("copies").alias("n_labels")
    )


