"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on a ring of 2**16 places ``nodes`` times. A row belongs to the first node at or after the place of
its doc_id's hash, and goes to that node's shard unless the shard is full: then it goes on clockwise to the next shard
that has room. No shard takes more than its share of all bytes times 1 + ``slack`` (and one row of the size class in which it
filled up), so the others hold nearly as much, whatever the keys: a doc_id with a third of all rows fills its
shard and runs over into the next ones.

Rows enter in one fixed order: by size class (powers of two, large ones first), then along the ring. So what fills a shard to
the brim are small rows, and sizes come out even. Only the bytes per (size class, arc of the ring) reach the driver, which walks
through them once: at most (classes x shards x ``nodes``) numbers, however many rows there are. A cell of them
goes to one shard as a whole, or is cut where a shard becomes full, at most once per class and shard; rows of cut cells are
ranked by sums over buckets, so that no task holds a whole cell.

Law: ``bytes``. Sizes (UTF-8 bytes and one) of the shards are near equal; the shard of a row depends on the doc_ids and sizes
of the others only as far as shards are full. One more shard moves few rows beside those it takes: the nodes of
the others stay where they are.

Defined cases: a null text has size 1; a null doc_id is a key like any other; equal rows are rows of their own and may part;
ties in rank go by the number a row got when it was stored; very long texts are one row; an empty table gives an empty
result. Columns named like the outputs (size, shard, slot) are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.texts import table
from answerloom.session import stage

PLACES = 1 << 16
NODES = 128
SLACK = 0.0
ROWS_PER_BUCKET = 20_000
HELD = "_held"


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes, by place. Those of a shard do not depend on the number of shards; where two
    meet, the one of the higher shard goes on to the next free place."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            place = xxhash.xxh3_64_intdigest(f"{shard}/{node}".encode()) % PLACES
            while place in taken:
                place = (place + 1) % PLACES
            taken[place] = shard
    return sorted(taken.items())


def plan(
    cells: Iterable[tuple[int, int, int]], nodes: list[tuple[int, int]], shards: int, slack: float
) -> list[tuple[int, int, int, int]]:
    """(class, arc, first byte, shard) for all parts of cells (class, arc, bytes): the bytes of a cell from
    ``first byte`` up to that of its next part go to ``shard``."""
    cells = sorted(cells, key=lambda c: (-c[0], c[1]))
    room = [-(-sum(c[2] for c in cells) * (1 + slack) // shards)] * shards
    out = []
    for kind, arc, size in cells:
        at, steps = 0, 0
        while at < size:
            shard = nodes[(arc + steps) % len(nodes)][1]
            if steps >= len(nodes):  # rounding has left no room at all
                shard, part = max(range(shards), key=lambda s: room[s]), size - at
            else:
                part = int(min(size - at, room[shard]))
            if part > 0:
                out.append((kind, arc, at, shard))
                room[shard] -= part
                at += part
            steps += 1
    return out


def _clockwise(nodes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(place, arc) of every place: the number of the first node at or after it."""
    out, arc = [], 0
    for place in range(PLACES):
        while arc < len(nodes) and nodes[arc][0] < place:
            arc += 1
        out.append((place, arc % len(nodes)))
    return out


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _ranked(rows: DataFrame, keys: list[str], order: list[str], weight: Column, buckets: Column, name: str) -> DataFrame:
    """``rows`` (with ``row``, a number of its own each) with the sum of the weights before them among equal ``keys``. Sums run
    within buckets first, so a key with many rows is spread over tasks."""
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("row"), buckets).cast("int")).withColumn("_weight", weight)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_n"))
    shift = shift.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_sum", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    joined = summed.join(shift, [*keys, "_bucket"])
    return joined.withColumn(name, (F.col("_sum") + F.col("_shift")).cast("long")).drop("_bucket", "_weight", "_sum", "_shift")


def place_rows(held: DataFrame, shards: int, nodes: int = NODES, slack: float = SLACK) -> DataFrame:
    """``held`` (stored; row, key, size and more) with ``shard``."""
    spark = held.sparkSession
    points = ring(shards, nodes)
    # Places of the ring and parts of cells are bounded by PLACES and by classes x shards x nodes, whatever the corpus.
    arcs = F.broadcast(spark.createDataFrame(_clockwise(points), "_place int, _arc int"))
    cells = held.withColumn("_place", F.pmod(F.xxhash64("key"), F.lit(PLACES)).cast("int")).join(arcs, "_place")
    cells = cells.withColumn("_class", F.floor(F.log2("size")).cast("int")).drop("_place")
    found = cells.groupBy("_class", "_arc").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    parts = plan([(r["_class"], r["_arc"], r["bytes"]) for r in found], points, shards, slack)
    by_cell: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for kind, arc, first, shard in parts:
        by_cell.setdefault((kind, arc), []).append((first, shard))
    rows = {(r["_class"], r["_arc"]): r["n"] for r in found}
    schema = "_class int, _arc int, _first array<long>, _shard array<int>, _buckets int"
    table_of = [
        (*cell, [f for f, _ in x], [s for _, s in x], max(1, -(-rows[cell] // ROWS_PER_BUCKET))) for cell, x in by_cell.items()
    ]
    cells = cells.join(F.broadcast(spark.createDataFrame(table_of, schema)), ["_class", "_arc"])
    whole = cells.where(F.size("_shard") == 1).withColumn("shard", F.get("_shard", F.lit(0)))
    cut = _ranked(cells.where(F.size("_shard") > 1), ["_class", "_arc"], ["key", "row"], F.col("size"), F.col("_buckets"), "_from")
    part = F.size(F.filter("_first", lambda x: x <= F.col("_from"))) - 1
    cut = cut.withColumn("shard", F.get("_shard", part))
    return whole.unionByName(cut.select(*whole.columns)).drop("_class", "_arc", "_first", "_shard", "_buckets")


def assign(
    docs: DataFrame, shards: int, nodes: int = NODES, slack: float = SLACK, keep: list[str] | None = None
) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with size, shard and slot, gapless from 0 in each shard. ``keep`` names the columns that
    go along (all by default); texts are written once and shuffled once if they are among them."""
    keep = docs.columns if keep is None else keep
    others = [F.col(c) for c in keep if c.lower() not in ("size", "shard", "slot")]
    own = F.struct(*others).alias(HELD)
    held = docs.select(own, F.col("doc_id").alias("key"), size_of(F.col("text")).alias("size"))
    held = stage(held.withColumn("row", F.monotonically_increasing_id()), "sized")
    total = held.count()
    if not total:
        return held.select(f"{HELD}.*", "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed = stage(place_rows(held.select("row", "key", "size"), shards, nodes, slack).select("row", "shard"), "placed")
    buckets = F.lit(max(1, -(-total // (shards * ROWS_PER_BUCKET))))
    slots = _ranked(placed, ["shard"], ["row"], F.lit(1).cast("long"), buckets, "slot")
    return held.join(slots, "row").select(f"{HELD}.*", "size", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int, nodes: int = NODES, slack: float = SLACK) -> None:
    """One folder shard=k per shard, with all columns of ``docs``, its rows in files ordered by slot; no file holds
    more than ``ROWS_PER_BUCKET`` rows."""
    placed = assign(docs, shards, nodes, slack)
    placed = placed.withColumn("_part", F.floor(F.col("slot") / ROWS_PER_BUCKET))
    placed = placed.repartition(F.col("shard"), F.col("_part")).sortWithinPartitions("shard", "slot").drop("_part")
    placed.write.partitionBy("shard").option("maxRecordsPerFile", ROWS_PER_BUCKET).parquet(path)


def op11_bounded_ring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return assign(docs, 8, keep=["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
