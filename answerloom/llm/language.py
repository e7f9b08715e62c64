"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams per language are summed on Spark; the matrix of log probabilities (buckets x languages, a
size that does not depend on the corpus) is broadcast, and every batch of whole texts is scored in numpy as a
sparse product.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows without a language or text
teach nothing; ties go to the language first in order; without any taught language every text is ``und``;
repeated rows are scored each; all other columns of the input are kept, and a column named like an output is replaced.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.llm.texts import bounded_batches, crc32_of_id, forget, free_name, keep_share, strings, table

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
FIT_ROWS = 4000
SMOOTHING = 0.1
CHUNK = 1 << 18
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages, centred on each bucket's mean
    log_prior: np.ndarray


def ngram_buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Buckets of the n-grams of an array of code points."""
    n = len(points) - order + 1
    total = np.full(max(n, 0), order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        total = (total ^ points[k : k + len(total)]) * MULTIPLIERS[k]
        total ^= total >> np.uint32(15)
    return total & np.uint32(BUCKETS - 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _count(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), strings(batch["text"])):
            into = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            points = code_points(text)
            for start in range(0, len(points), CHUNK):
                for order in ORDERS:
                    into += np.bincount(ngram_buckets(points[start : start + CHUNK + order - 1], order), minlength=BUCKETS)
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
            names=["lang", "bucket", "n"],
        )


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on (doc_id, text, lang). About ``fit_rows`` documents a language are read, all where there are fewer;
    priors come from all of them."""
    bounded_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, fit_rows / sizes[lang]))])
    # The id is null-safe, and the text takes part so that rows of one id are not all in or all out.
    sample = known.where(keep_share(F.struct("doc_id", F.length("text")), shares[F.col("lang")]))
    counts = (
        sample.select("lang", "text")
        .mapInArrow(_count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    matrix = np.full((BUCKETS, len(languages)), SMOOTHING)
    column = {lang: k for k, lang in enumerate(languages)}
    np.add.at(
        matrix,
        (counts["bucket"].to_numpy(), np.array([column[x] for x in counts["lang"].to_pylist()], int)),
        counts["n"].to_numpy(),
    )
    log_prob = np.log(matrix / matrix.sum(axis=0))
    log_prob -= log_prob.mean(axis=1, keepdims=True)
    prior = np.array([sizes[x] for x in languages], float)
    return LanguageModel(languages, np.ascontiguousarray(log_prob, np.float32), np.log(prior / prior.sum()))


def log_likelihoods(texts: list[str], model: LanguageModel) -> np.ndarray:
    """Sums of log probabilities per text and language; texts are cut into chunks of code points, none is left out."""
    points = [code_points(x) for x in texts]
    out = np.zeros((len(texts), len(model.languages)))
    columns = [np.ascontiguousarray(model.log_prob[:, k], np.float64) for k in range(len(model.languages))]
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush():
        nonlocal size
        if held:
            rows = np.array([r for r, _ in held])
            buckets = np.concatenate([b for _, b in held])
            starts = np.cumsum([0, *(len(b) for _, b in held[:-1])])
            for k, column in enumerate(columns):
                out[:, k] += np.bincount(rows, np.add.reduceat(column.take(buckets), starts), minlength=len(texts))
            held.clear()
            size = 0

    for row, p in enumerate(points):
        for start in range(0, len(p), CHUNK):
            for order in ORDERS:
                b = ngram_buckets(p[start : start + CHUNK + order - 1], order)
                if len(b):
                    held.append((row, b))
                    size += len(b)
        if size >= CHUNK:
            flush()
    flush()
    return out


def posteriors(texts: list[str | None], model: LanguageModel) -> tuple[list[str], list[float]]:
    lettered = [k for k, x in enumerate(texts) if x and has_letter(x)] if model.languages else []
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if lettered:
        logits = log_likelihoods([texts[k] for k in lettered], model) + model.log_prior
        best = logits.argmax(axis=1)
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        for k, b, p in zip(lettered, best.tolist(), (1 / odds.sum(axis=1)).tolist()):
            lang[k], score[k] = model.languages[b], p
    return lang, score


def _predict(batches, shared, position, kept, outputs):
    forget()
    model = shared.value
    for batch in batches:
        lang, score = posteriors(batch.column(position).to_pylist(), model)
        columns = [batch.column(k) for k in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
        names = [batch.schema.names[k] for k in kept] + list(outputs)
        yield pa.record_batch(columns, names=names)


def predict(docs: DataFrame, model: LanguageModel, outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` with the predicted language and its posterior."""
    bounded_batches(docs.sparkSession)
    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in outputs]
    schema = T.StructType(
        [docs.schema[k] for k in kept] + [T.StructField(outputs[0], T.StringType()), T.StructField(outputs[1], T.DoubleType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    position = docs.columns.index("text")
    return docs.mapInArrow(functools.partial(_predict, shared=shared, position=position, kept=kept, outputs=outputs), schema)


def confident(docs: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """The rows with a language of at least ``min_score``; columns as they came."""
    lang, score = free_name(docs, "_lid_lang"), free_name(docs, "_lid_score")
    scored = predict(docs, model, (lang, score))
    return scored.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc32_of_id(), F.lit(4)) == 2
    model = fit(docs.where(~held_out))
    scored = predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")
