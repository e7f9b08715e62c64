r"""Document fingerprints: MinHash over word shingles.

``PERMUTATIONS`` universal hash functions (a * x + b modulo 2**64, a odd) are applied to the 64-bit hashes of a text's
shingles of five words, in blocks in numpy; the least value of each is reduced to 16 bits. The share of
equal values estimates the Jaccard index of two texts. ``near_duplicates`` joins bands of the signature in
Spark and verifies the pairs by their true Jaccard index; ``with_next`` compares each text with an edited form
of itself and with the next document.

Defined cases: null text is empty; texts without a word share the fingerprint of the empty set, whose likeness to each
other is 1; with fewer than five words the whole sequence is one shingle; rows with equal doc_id are ordered by the
hash of their text, equal rows stand next to each other; a null doc_id is the least; a single document is its own
next one; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.skew import fits_broadcast, salted_join
from answerloom.llm.linking import link_groups
from answerloom.llm.ngram_join import BROADCAST_ROWS, SALTS, WORDS64, jaccard_filter, parities, token_set
from answerloom.llm.texts import M1, bounded_batches, mixed, shingle_hashes, table, utf8, word_hashes, words
from answerloom.session import stage

PERMUTATIONS = 128
SHINGLE = 5
BLOCK = 512
BANDS, ROWS = 25, 5
PERCENT = 80
MAX_PARTS = 20_000
EMPTY = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)

_random = np.random.default_rng(20240229)
FACTORS = (_random.integers(0, 1 << 63, PERMUTATIONS, np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
SHIFTS = _random.integers(0, 1 << 63, PERMUTATIONS, np.uint64)[:, None]


def least(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function."""
    out = EMPTY
    for start in range(0, len(shingles), BLOCK):
        values = FACTORS * shingles[None, start : start + BLOCK]
        values += SHIFTS
        out = np.minimum(out, values.min(axis=1))
    return out


def signature(minima: np.ndarray) -> np.ndarray:
    return mixed(minima).astype(np.uint16)


def text_hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


def shingles_of(text: bytes) -> np.ndarray:
    return shingle_hashes(word_hashes(words(text)), SHINGLE)


class _Open:
    """A document that waits for the next one. The windows before the cut serve the edited text too."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 3
        shingles = shingles_of(text.encode())
        self.shared = max(0, len(text[: self.cut].encode().split()) - SHINGLE)
        self.before = least(shingles[: self.shared])
        self.signature = signature(np.minimum(self.before, least(shingles[self.shared :])))

    def row(self, following: _Open) -> tuple:
        edited = (self.text[: self.cut] + following.text[: len(self.text) - self.cut]).encode()
        other = signature(np.minimum(self.before, least(shingles_of(edited)[self.shared :])))
        return (
            self.doc_id,
            len(self.text),
            hashlib.sha256(edited).hexdigest(),
            text_hex(self.signature),
            text_hex(other),
            likeness(self.signature, other),
            likeness(self.signature, following.signature),
        )


NEXT_COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _stream(batches, id_type):
    """Rows come by (part, last, place); the row marked last is the first document of the part that follows."""
    waiting, part = None, None
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        done = []
        for at, last, doc_id, text in zip(*(batch[c].to_pylist() for c in ("part", "last", "doc_id", "text"))):
            if at != part:
                part, waiting = at, None
            elif waiting is None:
                continue  # a further row equal to the one marked last
            now = _Open(doc_id, text or "")
            if waiting is not None:
                done.append(waiting.row(now))
            waiting = None if last else now
        columns = list(zip(*done)) if done else [[]] * len(types)
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types)], names=list(NEXT_COLUMNS))


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited form, and their likeness, by descending doc_id.

    Texts are shuffled once, by ranges of doc_id; the first document of each range (one row per range, found on
    ids alone) goes to the range before it as well, so no window over all rows is needed.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    identity = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id")
    digest = F.xxhash64("text").alias("h")
    place = docs.select(identity, digest)
    parts = min(MAX_PARTS, 2 * max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()))
    shares = [k / parts for k in range(1, parts)]
    bounds = place.agg(F.percentile_approx("id", shares, max(10_000, 10 * parts)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))

    def part_of(ids: pd.Series) -> np.ndarray:
        return len(bounds) - np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(), side="right")

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(part_of(ids), dtype="int32")

    heads = place.withColumn("part", part("id")).groupBy("part").agg(F.max(F.struct("id", "h")).alias("top")).collect()
    order = sorted(r["part"] for r in heads)
    before = {p: order[k - 1] for k, p in enumerate(order)}  # the part before the first is the last
    first = {(r["top"]["id"], r["top"]["h"]): before[r["part"]] for r in heads}

    @F.pandas_udf("array<struct<part:int,last:boolean>>")
    def targets(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        out = []
        for own, key in zip(part_of(ids).tolist(), zip(ids.tolist(), hashes.tolist())):
            also = first.get(key)
            out.append([{"part": own, "last": False}] + ([{"part": also, "last": True}] if also is not None else []))
        return pd.Series(out)

    dealt = docs.select("doc_id", "text", identity, digest).withColumn("t", F.explode(targets("id", "h")))
    dealt = dealt.select("t.*", "doc_id", "text", "id", "h")
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "last", F.desc("id"), F.desc("h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int32() if kind == "int" else pa.int64()
    return ordered.select("part", "last", "doc_id", "text").mapInArrow(
        functools.partial(_stream, id_type=id_type),
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _signatures(batches):
    for batch in batches:
        sets = [token_set(x, SHINGLE) for x in utf8(batch["text"])]
        bands = []
        for shingles in sets:
            sig = signature(least(shingles)).astype(np.uint64)
            parts = functools.reduce(lambda x, y: mixed(x * M1 + y), sig[: BANDS * ROWS].reshape(BANDS, ROWS).T)
            bands.append(parts.view(np.int64))
        signs = np.frombuffer(b"".join(map(parities, sets)), np.int64).reshape(-1, WORDS64)
        made = [
            pa.array([len(x) for x in sets], pa.int64()),
            pa.array([hash_of(x) if len(x) else None for x in sets], pa.int64()),
            pa.array(bands, pa.list_(pa.int64())),
            *(pa.array(signs[:, k]) for k in range(WORDS64)),
        ]
        names = ["doc_id", "text_hash", "n", "id", "bands", *(f"p{k}" for k in range(WORDS64))]
        yield pa.record_batch([batch["doc_id"], batch["text_hash"], *made], names=names)


def hash_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable over pairs that share a band of the signature and whose
    sets of A-Z lower-cased five-word shingles have a Jaccard index of at least ``percent``."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        _signatures, f"doc_id {kind}, text_hash long, n long, id long, bands array<long>" + "".join(f", p{k} long" for k in range(WORDS64))
    )
    rows = stage(made, "signatures")
    sets = stage(rows.where("id is not null").dropDuplicates(["id"]), "sets")
    members = stage(sets.select("id", F.posexplode("bands").alias("band", "value")), "bands")
    common = members.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    live = stage(members.join(common, ["band", "value"], "left_semi"), "shared-bands")
    same = jaccard_filter(docs, sets.drop("bands"), SHINGLE, percent)
    _, found = link_groups(live, ["band", "value"], [], F.col("id"), lambda x, y: F.lit(True), same)
    least_id = rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"))
    least_id = least_id.join(stage(found, "components"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = least_id.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(least_id.join(names, "component").select("id", "component_id"), "names")
    joined = salted_join(rows, named, ["id"], ["doc_id"], SALTS, how="left", fits=fits_broadcast(named, BROADCAST_ROWS))
    return joined.select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_document_fingerprints(spark, sf_dir):
    return with_next(table(spark, sf_dir, "documents"))
