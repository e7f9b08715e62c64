"""Joins on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def dealt(df: DataFrame) -> DataFrame:
    """The side of a join that is dealt out by key and never broadcast. Spark sizes a table by its compressed files, and rows made by
    an explode like the row they come from, so it may find a table small that is not."""
    return df.hint("merge")


# Rows of (key, number, score) that fit in an executor's memory many times over: some 50 MB.
BROADCAST_ROWS = 500_000


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: list[str],
    salts: int = 8,
    how: str = "inner",
    fits: bool = False,
) -> DataFrame:
    """Join ``big`` with ``small`` (``how`` from the side of ``big``), a hot key cut into ``salts`` parts.

    ``spread`` names columns of ``big`` that differ between rows of one key. Where the caller has checked
    that ``small`` fits, it is broadcast and ``big`` is not shuffled at all; otherwise its copies are ``dealt``.
    """
    if fits:
        return big.join(F.broadcast(small), on, how)
    left = big.withColumn(SALT, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(dealt(right), [*on, SALT], how).drop(SALT)


HOT_SHARE = 1e-4


def lookup_document_frequency(
    postings: DataFrame, frequencies: DataFrame, n_units: Column | int, share: float = HOT_SHARE
) -> DataFrame:
    """Add ``df`` of term ``t`` to postings (rows distinct per unit and term); 0 for terms never seen.

    Terms in at least ``share`` of the units are joined by broadcast. Each of them accounts for
    ``share * N`` postings, so there are at most (mean distinct terms per unit) / share of them,
    whatever the size of the corpus. The other terms have few postings each and are shuffled. Where N is
    known and at most 1 / share, every term is of the first kind.
    """
    if isinstance(n_units, int) and share * n_units <= 1:
        return _known(postings.join(F.broadcast(frequencies), "t", "left"))
    limit = (n_units if isinstance(n_units, Column) else F.lit(n_units)) * share
    hot = F.broadcast(frequencies.where(F.col("df") >= limit))
    cold = frequencies.where(F.col("df") < limit)
    frequent = postings.join(hot, "t")
    rare = postings.join(hot.select("t"), "t", "left_anti").join(cold, "t", "left")
    return frequent.unionByName(_known(rare))


def _known(joined: DataFrame) -> DataFrame:
    return joined.withColumn("df", F.coalesce("df", F.lit(0).cast("bigint")))
