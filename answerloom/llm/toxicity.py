"""Toxicity: a linear classifier on the presence of character n-grams, features scaled by naive Bayes log-count ratios.

The classifier is fitted on a bounded sample of labelled rows (``fit_rows`` a class); every whole text is scored.

Defined cases: null and empty texts have no feature and get the score of the intercept; rows without a label or
a text teach nothing; without both classes every score is the share of class 1 (0 without labels); a document
labelled more than once counts with its highest label; repeated rows are scored each; only the named columns are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.texts import bounded_batches, crc32_of_id, keep_share, strings, table

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
ORDERS = (4, 5)
FIT_ROWS = 3000
MIN_DOCUMENTS = 3
MIN_RATIO = 1.0
THRESHOLD = 0.7
CHUNK = 1 << 20


@dataclass
class ToxicityModel:
    weight: np.ndarray  # per bucket, ratio and linear weight multiplied
    intercept: float


def presence(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted buckets of the n-grams in a text; ``seen`` is an all-false work array and is left so."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(points), CHUNK):
        for order in ORDERS:
            part = points[start : start + CHUNK + order - 1]
            n = len(part) - order + 1
            if n <= 0:
                continue
            total = np.full(n, order, np.uint32)
            for k in range(order):
                total *= np.uint32(0x9E3779B1)
                total += part[k : k + n]
            total *= np.uint32(0x85EBCA6B)
            seen[total >> np.uint32(32 - BUCKET_BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def _features(batches):
    seen = np.zeros(BUCKETS, bool)
    for batch in batches:
        sets = [presence(x, seen).astype(np.int32).tobytes() for x in strings(batch["text"])]
        yield pa.record_batch([batch["toxic"].cast(pa.int32()), pa.array(sets, pa.binary())], names=["toxic", "found"])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the documents with a label of 0 or 1. ``labels`` is a sample of bounded size, so it is
    broadcast and no text is shuffled."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = 60, l2: float = 2.0) -> ToxicityModel:
    """Fit on at most about ``fit_rows`` documents a class, the same ones each time. Labels are few and narrow, so
    the sample is drawn from them before any text is joined."""
    bounded_batches(docs.sparkSession)
    clean = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1))
    sizes = {r["toxic"]: r["n"] for r in clean.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 40.0 if sizes.get(1) else -40.0)
    share = F.when(F.col("toxic") == 1, min(1.0, fit_rows / sizes[1])).otherwise(min(1.0, fit_rows / sizes[0]))
    sample = clean.where(keep_share(F.col("doc_id"), share))
    rows = labelled(docs, sample).select("toxic", "text").mapInArrow(_features, "toxic int, found binary").toArrow()
    y = rows["toxic"].to_numpy().astype(float)
    sets = [np.frombuffer(x, np.int32) for x in rows["found"].to_pylist()]
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 40.0 if len(y) and y.max() else -40.0)
    return _train(sets, y, rounds, l2)


def _train(sets: list[np.ndarray], y: np.ndarray, rounds: int, l2: float) -> ToxicityModel:
    """Log-count ratios, then logistic regression on the scaled features by gradient steps with momentum (Adam)."""
    toxic = np.zeros(BUCKETS)
    clean = np.zeros(BUCKETS)
    for found, label in zip(sets, y):
        (toxic if label else clean)[found] += 1
    p, q = toxic + 1, clean + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    known = (toxic + clean >= MIN_DOCUMENTS) & (np.abs(ratio) >= MIN_RATIO)
    ratio = np.where(known, ratio, 0.0)
    sets = [x[known[x]] for x in sets]
    indices = np.concatenate(sets) if sets else np.zeros(0, int)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = ratio[indices]
    share = y.mean()
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w, b = np.zeros(BUCKETS), 0.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(rows, values * w[indices], minlength=len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance
        g = np.bincount(indices, values * error[rows], minlength=BUCKETS) + l2 * w / len(y)
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= 0.02 * fix * m / (np.sqrt(v) + 1e-8)
        b -= 0.02 * fix * mb / (np.sqrt(vb) + 1e-8)
    return ToxicityModel((w * ratio).astype(np.float32), float(b))


def _score(batches, shared):
    model, seen = shared.value, np.zeros(BUCKETS, bool)
    for batch in batches:
        z = np.array([model.weight[presence(x, seen)].sum(dtype=np.float64) for x in strings(batch["text"])])
        p = 1 / (1 + np.exp(-np.clip(z + model.intercept, -40, 40)))
        yield pa.record_batch(
            [batch["doc_id"], batch["held_out"], pa.array(p, pa.float64())], names=["doc_id", "held_out", "score"]
        )


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of (doc_id, text, held_out)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text", "held_out").mapInArrow(
        functools.partial(_score, shared=shared), f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(crc32_of_id(), F.lit(3)) == 1
    model = fit(docs, labels.where(~held_out))
    return score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
