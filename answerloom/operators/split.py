"""Cutting documents into passages. Every splitter is row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.text import each, let, sentences, words


def word_windows(text: Column, length: int, overlap: int = 0) -> Column:
    """Windows of ``length`` words; the last window adds at least one new word."""
    if not 0 <= overlap < length:
        raise ValueError("overlap must be in [0, length)")
    step = length - overlap

    def cut(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda p: F.array_join(F.slice(w, p * step + 1, length), " "),
            )
        )

    return let(words(text), cut)


def split_words(df: DataFrame, length: int = 200, overlap: int = 0, text: str = "text") -> DataFrame:
    """Replace ``text`` by one row (split_id, content) per window of words."""
    keep = [c for c in df.columns if c != text]
    return each(df, keep, word_windows(F.col(text), length, overlap), "content", "split_id")


def sentence_groups(text: Column, length: int) -> Column:
    """Greedy packing of whole sentences into groups of at most ``length`` words.

    A sentence over the length stays whole, in a group of its own. The fold carries (first, size,
    words) of the open group and appends a closed group only when it ends, so the sentences
    themselves are never copied.
    """

    def pack(s: Column) -> Column:
        counts = F.transform(s, lambda x: F.size(words(x)))
        start = F.struct(
            F.lit(1).alias("first"),
            F.lit(0).alias("size"),
            F.lit(0).alias("total"),
            F.array().cast("array<struct<first:int,size:int>>").alias("done"),
        )

        def step(acc: Column, n: Column) -> Column:
            fits = (acc["size"] == 0) | (acc["total"] + n <= length)
            closed = F.struct(acc["first"].alias("first"), acc["size"].alias("size"))
            return F.struct(
                F.when(fits, acc["first"]).otherwise(acc["first"] + acc["size"]).alias("first"),
                F.when(fits, acc["size"] + 1).otherwise(F.lit(1)).alias("size"),
                F.when(fits, acc["total"] + n).otherwise(n).alias("total"),
                F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(closed))).alias("done"),
            )

        def finish(acc: Column) -> Column:
            last = F.struct(acc["first"].alias("first"), acc["size"].alias("size"))
            return F.when(acc["size"] > 0, F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

        return F.transform(F.aggregate(counts, start, step, finish), lambda g: F.slice(s, g["first"], g["size"]))

    return let(sentences(text), pack)


def split_sentences(
    df: DataFrame, length: int = 100, text: str = "text", hard_max: bool = False, keep_sentences: bool = False
) -> DataFrame:
    """One row (split_id, content) per group of sentences; ``hard_max`` cuts oversize sentences by words."""
    keep = [c for c in df.columns if c != text]
    groups = sentence_groups(F.col(text), length)
    if keep_sentences:
        return each(df, keep, groups, "sentences", "split_id")
    joined = F.transform(groups, lambda g: F.array_join(g, " "))
    if hard_max:
        joined = F.flatten(F.transform(joined, lambda c: word_windows(c, length)))
    return each(df, keep, joined, "content", "split_id")


def chunk_id(parent: Column, split_id: Column) -> Column:
    """Hash of the parent text plus the split number."""
    return F.concat(F.md5(parent.cast("binary")), F.lit("-"), split_id.cast("string"))
