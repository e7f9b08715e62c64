"""BM25 over stored postings with score bounds per block.

Units are packed into blocks of up to ``UNITS`` where they lie: neither texts nor postings are shuffled. A row of the stored
blocks is one block as ``blocks`` scores it: units, terms and weights. Beside it are the bounds: for one term in one block how many
units have it and the largest weight it has in any of them. A search first reads only the bounds: a unit cannot
score more than the sum of its block's bounds over the query's terms. The blocks with the highest bounds are scored
first; their k-th best score then rules out every block whose bound is below it, and the rest is scored. The
result is that of scoring everything: a unit left out has a bound, and so a score, below k others.

Terms are hashes of 64 bits. No row is made of a query and a unit: a task keeps the k best units of a query. No key is hot: a
term that all units have has one bound per block. Units that share a key count as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.ranking import top_k
from answerloom.functions.skew import fits_broadcast
from answerloom.operators import blocks
from answerloom.operators.sparse import B, K1, bm25_idf, bm25_term_weight, hashed_tokens, query_terms, units_by_key, weighted_units
from answerloom.operators.terms import corpus_size
from answerloom.session import stage

UNITS = 128
SEED_BLOCKS = 4
# Scores are rounded to six decimals, bounds are not.
MARGIN = 2e-6
# Pairs of a query and an open block that are broadcast, 12 bytes each.
OPEN_PAIRS = 4_000_000


def write_blocks(units: DataFrame, path: str, per_block: int = UNITS, k1: float = K1, b: float = B) -> None:
    """Store the blocks, their bounds (t, block, n, most) and the size of the corpus, for a BM25 with these parameters."""
    spark = units.sparkSession
    corpus_size(units, "content").select("n", "avgdl", F.lit(k1).alias("k1"), F.lit(b).alias("b")).write.mode(
        "overwrite"
    ).parquet(f"{path}/size")
    avgdl = F.lit(spark.read.parquet(f"{path}/size").first()["avgdl"]).cast("double")
    once, merged = units_by_key(units.select("uid", hashed_tokens(F.col("content")).alias("ts")))
    rows = once.where(F.size("ts") > 0).withColumn("ws", F.lit(None).cast("array<double>"))
    if merged is not None:
        part = bm25_term_weight(F.col("tf"), F.col("dl"), avgdl, F.lit(1.0), k1, b)
        rows = rows.unionByName(weighted_units(merged, part))
    held = blocks.unit_blocks(rows.withColumn("avgdl", avgdl), k1, b, per_block)
    held.write.mode("overwrite").parquet(f"{path}/blocks")
    stored = spark.read.schema(held.schema).parquet(f"{path}/blocks").select("u_block", "u_terms", "u_weights")
    bounds = stored.mapInArrow(_bounds, "t bigint, block bigint, n bigint, most double")
    if merged is not None:
        # A term is counted once for every length of the units that share a key.
        more = merged.groupBy("uid", "t").agg((F.count("*") - 1).alias("n")).where("n > 0").groupBy("t").agg(F.sum("n").alias("n"))
        bounds = bounds.unionByName(more.select("t", F.lit(None).cast("bigint").alias("block"), "n", F.lit(0.0).alias("most")))
    bounds.write.mode("overwrite").parquet(f"{path}/bounds")


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            terms, weights = (np.frombuffer(batch[c][r].as_buffer(), kind) for c, kind in (("u_terms", np.int64), ("u_weights", np.float64)))
            order = np.argsort(terms, kind="stable")
            t, first, n = np.unique(terms[order], return_index=True, return_counts=True)
            most = np.maximum.reduceat(weights[order], first) if len(first) else np.zeros(0)
            block = np.full(len(t), batch["u_block"][r].as_py(), np.int64)
            yield pa.record_batch([pa.array(t), pa.array(block), pa.array(n.astype(np.int64)), pa.array(most)], names=["t", "block", "n", "most"])


@dataclass
class Pruned:
    """``hits`` as from ``bm25_topk``; ``bounds`` has every (q, block) with a term in common, ``read`` those that were scored."""

    hits: DataFrame
    bounds: DataFrame
    read: DataFrame


def search(queries: DataFrame, path: str, k: int = 5, seed: int = SEED_BLOCKS) -> Pruned:
    spark = queries.sparkSession
    held = spark.read.parquet(f"{path}/blocks")
    size = spark.read.parquet(f"{path}/size").first()
    asked = stage(query_terms(queries).select("q", F.xxhash64("t").alias("t")), "query-terms")
    few = fits_broadcast(asked)
    small = lambda df: F.broadcast(df) if few else df
    listed = spark.read.parquet(f"{path}/bounds").join(small(asked.select("t").distinct()), "t", "left_semi")
    listed = stage(listed, "bounds")
    df = listed.groupBy("t").agg(F.sum("n").alias("df"))
    terms = stage(asked.join(df, "t").select("q", "t", bm25_idf(F.lit(size["n"]), F.col("df")).alias("weight")), "weighted-terms")
    met = listed.where(F.col("block").isNotNull()).join(small(terms), "t")
    bounds = stage(met.groupBy("q", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")), "block-bounds")
    first = stage(top_k(bounds, ["q"], [F.desc("bound"), F.asc("block")], seed).select("q", "block"), "seed-blocks")
    packed = blocks.query_blocks(terms)
    scored = stage(_best(first, packed, held, k), "seed-scores")
    enough = scored.where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    open_blocks = bounds.join(enough, "q", "left").where(F.col("bound") + MARGIN >= F.coalesce("least", F.lit(0.0)))
    rest = stage(open_blocks.select("q", "block").join(first, ["q", "block"], "left_anti"), "open-blocks")
    found = scored.unionByName(_best(rest, packed, held, k)).drop("rank")
    return Pruned(top_k(found, ["q"], [F.desc("score"), F.asc("uid")], k), bounds, first.unionByName(rest))


def _best(wanted: DataFrame, packed: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(q, uid, score, rank) of the k best units of a query in its wanted (q, block)."""
    place = packed.select(F.col("q_block").alias("open_block"), F.posexplode("q_ids").alias("at", "q"))
    listed = wanted.join(place, "q").groupBy(F.col("block").alias("u_block")).agg(F.collect_list(F.struct("open_block", "at")).alias("x"))
    listed = listed.select("u_block", F.col("x.open_block").alias("open_blocks"), F.col("x.at").alias("open_at"))
    few = fits_broadcast(wanted, OPEN_PAIRS)
    return blocks.best(packed, held.join(F.broadcast(listed) if few else listed, "u_block"), k)


def bm25_topk_pruned(queries: DataFrame, path: str, k: int = 5, seed: int = SEED_BLOCKS) -> DataFrame:
    """(q, uid, score, rank) as ``bm25_topk``, from the tables of ``write_blocks``."""
    return search(queries, path, k, seed).hits


def postings_read(found: Pruned) -> DataFrame:
    """One row (blocks, blocks_read): how many blocks hold a term of a query, and how many were scored."""
    return found.bounds.agg(F.count("*").alias("blocks")).join(found.read.agg(F.count("*").alias("blocks_read")), F.lit(True))
