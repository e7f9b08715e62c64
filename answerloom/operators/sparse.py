"""Sparse retrieval: BM25 and TF-IDF top-k for many queries at once.

Queries are a table (q, query), units a table (uid, content).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.functions.ranking import ln_ratio, round6, top_k
from answerloom.functions.skew import fits_broadcast, lookup_document_frequency, salted_join
from answerloom.functions.text import each, tokens
from answerloom.operators import blocks
from answerloom.operators.terms import (
    corpus_size,
    document_frequency,
    smooth_idf,
    term_counts,
    tfidf_weights,
    unit_tokens,
)
from answerloom.session import spread, stage

# The usual BM25 parameters.
K1 = 1.2
B = 0.75


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    return each(queries, ["q"], F.array_distinct(tokens(F.col(text))), "t")


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25_term_weight(tf: Column, dl: Column, avgdl: Column, idf: Column, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def matching_counts(units: DataFrame, vocabulary: DataFrame, fits: bool) -> DataFrame:
    """(uid, t, dl, tf) of the terms in ``vocabulary``.

    Other tokens are dropped before anything is shuffled. Shuffling by unit alone lets the counts, the
    scores and their sums per (query, unit) all be computed in one place.
    """
    found = salted_join(unit_tokens(units, ["uid"], "content"), vocabulary, ["t"], ["uid"], how="left_semi", fits=fits)
    return found.repartition("uid").groupBy("uid", "t", "dl").agg(F.count("*").alias("tf"))


def _sum_by_unit(
    asked: DataFrame, counts: DataFrame, n: Column, avgdl: Column, fits: bool, k1: float, b: float
) -> DataFrame:
    idf = document_frequency(counts).select("t", bm25_idf(n, F.col("df")).alias("idf"))
    weighted_terms = salted_join(asked, idf, ["t"], ["q"], fits=fits)
    return (
        salted_join(counts, weighted_terms, ["t"], ["uid"], fits=fits)
        .select(
            "q", "uid", bm25_term_weight(F.col("tf"), F.col("dl"), avgdl, F.col("idf"), k1, b).alias("part")
        )
        .groupBy("q", "uid")
        .agg(round6(F.sum("part")).alias("score"))
    )


def bm25_scores(queries: DataFrame, units: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(q, uid, score) of every unit that shares a term with the query.

    Query terms are broadcast if there are few enough of them; otherwise both joins on a term are salted
    by unit.
    """
    asked = query_terms(queries)
    fits = fits_broadcast(asked)
    counts = matching_counts(units, asked.select("t").distinct(), fits)
    size = corpus_size(units, "content")
    return _sum_by_unit(asked, counts, size.select("n").scalar(), size.select("avgdl").scalar(), fits, k1, b)


def write_postings(units: DataFrame, path: str) -> None:
    """Term counts and corpus size as tables, so that later queries need not read the texts.

    Sorted by (term, unit) over range partitions: a file covers few terms, and a term in very many units
    spans several files.
    """
    counts = term_counts(units, ["uid"], "content")
    counts.repartitionByRange("t", "uid").sortWithinPartitions("t", "uid").write.mode("overwrite").parquet(
        f"{path}/postings"
    )
    corpus_size(units, "content").write.mode("overwrite").parquet(f"{path}/size")


def bm25_topk_stored(queries: DataFrame, path: str, k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """As ``bm25_topk``, from the tables of ``write_postings``."""
    spark = queries.sparkSession
    asked = query_terms(queries)
    fits = fits_broadcast(asked)
    postings = spark.read.parquet(f"{path}/postings")
    vocabulary = asked.select("t").distinct()
    counts = salted_join(postings, vocabulary, ["t"], ["uid"], how="left_semi", fits=fits)
    size = spark.read.parquet(f"{path}/size").first()
    idf = document_frequency(counts).select("t", bm25_idf(F.lit(size["n"]), F.col("df")).alias("weight"))
    weights = salted_join(asked, idf, ["t"], ["q"], fits=fits).select("q", F.xxhash64("t").alias("t"), "weight")
    part = bm25_term_weight(F.col("tf"), F.col("dl"), F.lit(size["avgdl"]), F.lit(1.0), k1, b)
    units = weighted_units(counts.withColumn("t", F.xxhash64("t")), part).withColumn("avgdl", F.lit(size["avgdl"]))
    return blocks.topk(stage(weights, "weighted-terms"), units, k, k1, b)


def weighted_units(counts: DataFrame, part: Column) -> DataFrame:
    """(uid, ts, ws), one row per unit, from term counts (uid, t, dl, tf)."""
    per_term = counts.groupBy("uid", "t").agg(F.sum(part).alias("w"))
    return per_term.groupBy("uid").agg(F.collect_list(F.struct("t", "w")).alias("x")).select(
        "uid", F.col("x.t").alias("ts"), F.col("x.w").alias("ws")
    )


def hashed_tokens(content: Column) -> Column:
    return F.transform(tokens(content), lambda t: F.xxhash64(t))


def units_by_key(units: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of (uid, ts): units whose key is there once, and term counts (uid, t, dl, tf) of those that share one: they count as
    one unit."""
    keys = units.groupBy("uid").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    keys = stage(keys.select(F.col("uid").alias("_uid")), "repeated")
    if keys.isEmpty():
        return units, None
    same = F.col("uid").eqNullSafe(F.col("_uid"))
    shared = units.join(keys, same, "left_semi")
    return units.join(keys, same, "left_anti"), stage(_hash_counts(shared), "merged-counts")


def _hash_counts(units: DataFrame) -> DataFrame:
    listed = each(units.withColumn("dl", F.size("ts")), ["uid", "dl"], F.col("ts"), "t")
    return listed.groupBy("uid", "t", "dl").agg(F.count("*").alias("tf"))


def bm25_topk(queries: DataFrame, units: DataFrame, k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """(q, uid, score, rank): the k best units per query, ties by uid."""
    return Bm25(queries, units, k1, b).topk(k)


class Bm25:
    """Queries beside the units they ask. Texts are cut into tokens once and stored as hashes of 64 bits; units are scored block by
    block (``blocks``), so no row is ever made of a query and a unit that is not among its best."""

    def __init__(self, queries: DataFrame, units: DataFrame, k1: float = K1, b: float = B):
        self.k1, self.b = k1, b
        hashed = hashed_tokens(F.col("content"))
        self.units = stage(spread(units.select("uid", "content")).select("uid", hashed.alias("ts")), "unit-terms")
        size = self.units.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avgdl"))
        self.avgdl = size.select("avgdl").scalar()
        self.once, self.merged = units_by_key(self.units)
        asked = stage(query_terms(queries).select("q", F.xxhash64("t").alias("t")), "query-terms")
        fits = fits_broadcast(asked)
        listed = each(self.once, [], F.array_distinct("ts"), "t")
        if fits:
            listed = listed.join(F.broadcast(asked.select("t").distinct()), "t", "left_semi")
        if self.merged is not None:
            listed = listed.unionByName(self.merged.select("t"))
        df = listed.groupBy("t").agg(F.count("*").alias("df"))
        idf = df.select("t", bm25_idf(size.select("n").scalar(), F.col("df")).alias("weight"))
        self.weights = stage(salted_join(asked, idf, ["t"], ["q"], fits=fits), "weighted-terms")

    def _part(self, idf: Column) -> Column:
        return bm25_term_weight(F.col("tf"), F.col("dl"), self.avgdl, idf, self.k1, self.b)

    def topk(self, k: int) -> DataFrame:
        """(q, uid, score, rank)"""
        rows = self.once.where(F.size("ts") > 0).withColumn("ws", F.lit(None).cast("array<double>"))
        if self.merged is not None:
            rows = rows.unionByName(weighted_units(self.merged, self._part(F.lit(1.0))))
        return blocks.topk(self.weights, rows.withColumn("avgdl", self.avgdl), k, self.k1, self.b)

    def scores_of(self, pairs: DataFrame) -> DataFrame:
        """(q, uid, score) of the given pairs (q, uid) that have a term in common; only their units are counted."""
        pairs = stage(pairs.distinct(), "pairs")
        wanted = self.units.join(pairs.select("uid").distinct(), "uid", "left_semi")
        met = salted_join(_hash_counts(wanted), pairs, ["uid"], ["t"])
        return (
            met.join(self.weights, ["q", "t"])
            .groupBy("q", "uid")
            .agg(round6(F.sum(self._part(F.col("weight")))).alias("score"))
        )


def query_tfidf(
    queries: DataFrame, units: DataFrame | int, frequencies: DataFrame, fits: bool, hashed: bool = False
) -> DataFrame:
    """(q, t, wq): query weights with the statistics of the indexed units, scaled to length one.

    The vocabulary is first cut to the terms asked for; ``fits`` says whether those are few. ``units`` are the units or
    how many there are. With ``hashed`` the terms of the frequencies are hashes of 64 bits.
    """
    n = F.lit(units) if isinstance(units, int) else units.agg(F.count("*")).scalar()
    terms = hashed_tokens(F.col("query")) if hashed else tokens(F.col("query"))
    counts = each(queries, ["q"], terms, "t").groupBy("q", "t").agg(F.count("*").alias("tf"))
    vocabulary = counts.select("t").distinct()
    known = frequencies.join(F.broadcast(vocabulary) if fits else vocabulary, "t", "left_semi")
    raw = salted_join(counts, known, ["t"], ["q"], fits=fits).select(
        "q", "t", (F.col("tf") * (smooth_idf(n, F.col("df")) + 1)).alias("raw")
    )
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("q")))
    return raw.select("q", "t", (F.col("raw") / norm).alias("wq"))


def tfidf_scores(queries: DataFrame, units: DataFrame) -> DataFrame:
    """(q, uid, score): cosine of TF-IDF vectors."""
    fits = fits_broadcast(query_terms(queries))
    weights = tfidf_weights(units, ["uid"], "content")
    frequencies = weights.groupBy("t").agg(F.sum((F.col("w") > 0).cast("bigint")).alias("df"))
    asked = query_tfidf(queries, units, frequencies, fits)
    return (
        salted_join(weights, asked, ["t"], ["uid"], fits=fits)
        .groupBy("q", "uid")
        .agg(round6(F.sum(F.col("w") * F.col("wq"))).alias("score"))
    )


def unit_counts(units: DataFrame) -> DataFrame:
    """(uid, dl, ts, tfs): the distinct terms of a unit, as hashes of 64 bits, and how often it has them. Units of one key and length
    count as one. A unit is counted in its row; only units that share a key are shuffled."""
    rows = units.select("uid", hashed_tokens(F.col("content")).alias("ts"))
    schema = f"uid {dict(units.dtypes)['uid']}, dl int, ts array<bigint>, tfs array<bigint>"
    keys = units.groupBy("uid").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    keys = stage(keys.select(F.col("uid").alias("_uid")), "repeated")
    if keys.isEmpty():
        return rows.mapInArrow(_count_terms, schema)
    same = F.col("uid").eqNullSafe(F.col("_uid"))
    shared = _hash_counts(rows.join(keys, same, "left_semi")).groupBy("uid", "dl").agg(F.collect_list(F.struct("t", "tf")).alias("x"))
    shared = shared.select("uid", "dl", F.col("x.t").alias("ts"), F.col("x.tf").alias("tfs"))
    return rows.join(keys, same, "left_anti").mapInArrow(_count_terms, schema).unionByName(shared)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pa.array([bool(n) for n in batch.column(1).value_lengths().to_pylist()]))
        for i in range(0, batch.num_rows, blocks.UNITS):
            part = batch.slice(i, blocks.UNITS)
            sizes, ts = part.column(1).value_lengths().to_numpy(), part.column(1).flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((ts, row))
            row, ts = row[order], ts[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (ts[1:] != ts[:-1])])
            tf = np.diff(np.r_[first, len(ts)])
            yield _counted(part.column(0), sizes, row[first], ts[first], tf)


def _counted(uid: pa.Array, dl: np.ndarray, row: np.ndarray, ts: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(uid)))].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int64))) for v in (ts, tf)]
    return pa.record_batch([uid, pa.array(dl.astype(np.int32)), *lists], names=["uid", "dl", "ts", "tfs"])


def _asked_only(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """Counts without the terms that are not in ``asked`` (few), and without the units that are left with none."""
    terms = np.sort(asked.select("t").distinct().toArrow()["t"].to_numpy())
    shared = counts.sparkSession.sparkContext.broadcast(terms)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ts, tf = batch.column(2).value_lengths().to_numpy(), *(batch.column(c).flatten().to_numpy() for c in (2, 3))
            row = np.repeat(np.arange(len(sizes)), sizes)
            known = np.isin(ts, shared.value)
            if known.any():
                yield _counted(batch.column(0), batch.column(1).to_numpy(), row[known], ts[known], tf[known])

    return counts.select("uid", "dl", "ts", "tfs").mapInArrow(keep, counts.schema).where(F.size("ts") > 0)


def postings_of(counts: DataFrame) -> DataFrame:
    """(uid, t, tf) of ``unit_counts``."""
    return counts.select("uid", F.explode(F.arrays_zip("ts", "tfs")).alias("x")).select("uid", F.col("x.ts").alias("t"), F.col("x.tfs").alias("tf"))


def counted_frequency(counts: DataFrame) -> DataFrame:
    """(t, df) of ``unit_counts``."""
    return counts.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("df"))


def vector_lengths(counts: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """(uid, norm). The terms of a unit are summed where they lie, but for those in few units, which travel to their frequency."""
    raw = lookup_document_frequency(postings_of(counts), frequencies, n)
    raw = raw.withColumn("raw", F.col("tf") * (smooth_idf(F.lit(n), F.col("df")) + 1))
    return raw.groupBy("uid").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))


def tfidf_query_weights(queries: DataFrame, n: int, frequencies: DataFrame, fits: bool) -> DataFrame:
    """(q, t, weight): what a count of a term adds to the cosine, before the unit's length; terms as hashes."""
    asked = query_tfidf(queries, n, frequencies, fits, hashed=True)
    vocabulary = asked.select("t").distinct()
    df = frequencies.join(F.broadcast(vocabulary) if fits else vocabulary, "t", "left_semi")
    return asked.join(df, "t").select("q", "t", (F.col("wq") * (smooth_idf(F.lit(n), F.col("df")) + 1)).alias("weight"))


def counted_topk(queries: DataFrame, counts: DataFrame, norms: DataFrame, frequencies: DataFrame, n: int, k: int) -> DataFrame:
    """(q, uid, score, rank) by cosine, from ``unit_counts``, their ``vector_lengths`` and frequencies: scored block by block, so no row is
    made of a query and a unit that is not among its best."""
    fits = fits_broadcast(query_terms(queries))
    weights = stage(tfidf_query_weights(queries, n, frequencies, fits), "weighted-terms")
    kept = _asked_only(counts, weights) if fits else counts
    lengths = norms.select(F.col("uid").alias("_uid"), "norm")
    rows = kept.join(lengths, F.col("uid").eqNullSafe(F.col("_uid"))).select(
        "uid", "ts", F.transform("tfs", lambda x: x / F.col("norm")).alias("ws")
    )
    repeated = counts.groupBy("uid").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    repeated = stage(repeated.select(F.col("uid").alias("_uid")), "repeated")
    if not repeated.isEmpty():
        same = F.col("uid").eqNullSafe(F.col("_uid"))
        shared = rows.join(repeated, same, "left_semi").select("uid", F.explode(F.arrays_zip("ts", "ws")).alias("x"))
        shared = shared.groupBy("uid", F.col("x.ts").alias("t")).agg(F.sum("x.ws").alias("w"))
        shared = shared.groupBy("uid").agg(F.collect_list(F.struct("t", "w")).alias("x"))
        shared = shared.select("uid", F.col("x.t").alias("ts"), F.col("x.w").alias("ws"))
        rows = rows.join(repeated, same, "left_anti").unionByName(shared)
    return blocks.topk(weights, rows.withColumn("avgdl", F.lit(0.0)), k, K1, B)


def tfidf_topk(queries: DataFrame, units: DataFrame, k: int = 5) -> DataFrame:
    """(q, uid, score, rank): the k best of ``tfidf_scores`` per query, ties by uid."""
    counts = stage(unit_counts(spread(units.select("uid", "content"))), "unit-counts")
    frequencies, n = stage(counted_frequency(counts), "frequencies"), units.count()
    norms = stage(vector_lengths(counts, frequencies, n), "lengths")
    return counted_topk(queries, counts, norms, frequencies, n, k)


def rerank(
    queries: DataFrame,
    units: DataFrame,
    pool: int = 50,
    k: int = 5,
    scores: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """BM25 picks ``pool`` candidates per query, TF-IDF cosine (``scores`` if given, as a table or as a function of the pairs
    (q, uid) that are wanted) orders them."""
    candidates = bm25_topk(queries, units, pool).select("q", "uid", F.col("rank").alias("first_rank"))
    if callable(scores):
        candidates = stage(candidates, "candidates")
        scores = scores(candidates.select("q", "uid"))
    scored = (tfidf_scores(queries, units) if scores is None else scores).join(candidates, ["q", "uid"])
    return top_k(scored, ["q"], [F.desc("score"), F.asc("uid")], k)
