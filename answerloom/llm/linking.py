"""Groups of linked rows, from buckets of candidates to connected components, without all pairs of a group.

Two methods find near duplicates by buckets (bands of a signature, prefixes of sets, segments of lines). A bucket may
hold thousands of near copies, whose pairs nobody needs: rows that are linked to one row are one component already. So
candidates come in two parts: each row with the pivot of its bucket; and then only pairs of rows that lie in
different components after the pivots' links were found. No pair that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.session import stage

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id that can be reached.

    Alternates large and small stars; edges shrink to one star per component in a number of rounds that
    grows with the logarithm of the longest chain. Minima merge in each task before their shuffle, so a hub
    is no hot key, and every round is written to the shared folder.
    """
    one = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    current = stage(one.distinct(), "edges")
    seen = _state(current)
    for _ in range(MAX_ROUNDS):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _state(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def link_groups(
    members: DataFrame,
    key: list[str],
    payload: list[str],
    centre: Column,
    compatible: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Components of the rows that share a bucket and pass ``verify``.

    ``members`` (stored) has ``key`` columns, ``id`` and ``payload`` columns. The row with the least ``centre`` is the
    bucket's pivot. ``compatible(x, y)`` tells from the payloads of two aliases whether a pair can be linked at all;
    it must never refuse a linked pair. ``verify`` takes (a, b) and returns those that are linked.
    Returns (links found, components of the ids that have any).
    """
    columns = ["id", *payload]
    pivot = F.min(F.struct(centre.alias("_by"), *columns)).alias("p")
    shared = members.groupBy(*key).agg(pivot, F.count("*").alias("n")).where("n > 1")
    pivots = shared.select(*key, *[F.col(f"p.{c}").alias(c) for c in columns])
    star = _pairs(members, pivots, key, compatible, F.col("x.id") != F.col("y.id"))
    links = stage(verify(star), "pivot-links")
    found = stage(components(links), "pivot-components")
    # What is left: buckets whose rows lie in more than one component.
    labelled = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = stage(labelled, "labelled")
    split = (
        labelled.groupBy(*key, "component")
        .agg(F.count("*").alias("n"))
        .groupBy(*key)
        .agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts"))
        .where("parts > 1")
        .drop("parts")
    )
    open_rows = stage(labelled.join(split, key), "open-buckets")
    minor = open_rows.where("component <> main").drop("main")
    every = open_rows
    apart = (F.col("x.component") != F.col("y.component")) & (
        (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    )
    rest = stage(verify(_pairs(minor, every, key, compatible, apart)), "rest-links")
    links = links.union(rest)
    return links, components(links)


def _pairs(left: DataFrame, right: DataFrame, key: list[str], compatible, condition: Column) -> DataFrame:
    x, y = left.alias("x"), right.alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key]
    on = same[0]
    for c in [*same[1:], condition, compatible("x", "y")]:
        on = on & c
    pairs = x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return stage(pairs.distinct(), "candidates")
