"""Column expressions over text. All of them are row-local and run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns shared with the SQL checks.
NOT_WORD_CHARS = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"([.!?])\s+"
BREAK = "\u0001"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = ["a", "an", "the"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once; otherwise it is evaluated again in every step of an inner lambda."""
    return F.transform(F.array(value), body)[0]


def each(df: DataFrame, keep: list[str], items: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per item of an array built from text.

    The outer form is used because Catalyst guards a plain explode with a filter on the size of its array,
    which would build the array from the text three times.
    """
    if position is None:
        return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(items).alias(position, name)).where(F.col(position).isNotNull())


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD_CHARS), "")


def sentences(text: Column) -> Column:
    marked = F.regexp_replace(text, SENTENCE_END, "$1" + BREAK)
    return F.filter(F.split(marked, BREAK), lambda s: F.trim(s) != "")


def bare_word(word: Column) -> Column:
    return F.regexp_replace(word, NOT_WORD_CHARS, "")


def word_terms(text: Column) -> Column:
    """Terms of the whitespace words of a text, in order, without empty ones; two regex passes per text."""
    bare = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", ""))
    return F.array_remove(F.split(bare, r"\s+"), "")


def aligned_terms(word_list: Column) -> Column:
    """One term per word, "" for words without letters or digits."""
    bare = F.regexp_replace(F.array_join(word_list, " "), r"[^\p{L}\p{N} ]+", "")
    return F.split(F.lower(bare), " ")


def normal_answer(text: Column) -> Column:
    """Answer normalisation of the SQuAD scorer: case, ASCII punctuation, articles, spaces."""
    plain = F.regexp_replace(F.lower(text), ASCII_PUNCTUATION, "")
    return F.array_join(F.filter(words(plain), lambda w: ~w.isin(ARTICLES)), " ")


def word_ngrams(text: Column, n: int) -> Column:
    """Distinct word n-grams; the whole text where it has fewer than n words."""
    return let(
        words(text),
        lambda w: F.when(
            F.size(w) >= n,
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))),
                    lambda i: F.array_join(F.slice(w, i, n), " "),
                )
            ),
        ).otherwise(F.array(F.array_join(w, " "))),
    )
