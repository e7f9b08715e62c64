r"""LM scoring by cross-entropy difference.

Two word bigram models share one vocabulary: the target model counts the documents of the wanted quality, the
background model all documents. A document's score is the mean over its tokens of the target's loss less the
background's; the lower, the more it is like the target. Both are smoothed alike: where a
pair is rare, the word's own share counts.

Words are ``[^\x20\x09-\x0D]+``, lower-cased; words and pairs are told apart by their whole 64-bit hashes and counted
exactly over every document. Loss of word w after v:
-ln((c(v, w) + STRENGTH * p(w)) / (c(v) + STRENGTH)), p(w) = (c(w) + 1) / (N + V). V is the number of different words,
counted up to SKETCH and estimated from the SKETCH smallest hashes beyond.

Every token travels once, to the task of its word, which sees all pairs that end in the word and so counts and scores
them. Texts travel as row numbers, and what a task has for TEXTS of them goes back as one row of packed sums, at most one
sum a token; what is shuffled grows with the input. Words with a share of HOT in a sample are counted beforehand and their
tokens dealt by pair; pairs with such a share are not sent at all. Both are at most 1 / HOT in number whatever the input.

Defined cases: null and empty texts have no tokens and null scores; a text's first word follows a start mark; without
target documents the target gives every word the same loss; rows without a label are background only; documents that
occur more than once count each time; ties do not matter, scores are plain numbers. Only doc_id, text and the
label columns are read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.skew import fits_broadcast, salted_join
from answerloom.llm.texts import M1, bounded_batches, keep_share, mixed, table, utf8, word_hashes, words
from answerloom.session import stage

STRENGTH = 4.0
START = np.uint64(0x5851F42D4C957F2D)
BROADCAST_ROWS = 500_000
SAMPLE_ROWS = 4000
HOT = 2e-4
SKETCH = 4096
LEAST = 5
PER_PARTITION = 4
SALTS = 32
SUMS = ("n", "docs", "a", "b")
# Rows, numbered one after another, whose sums go back together.
TEXTS = 2048
# Batches are sent as one until a bucket has some tokens of them, or they have as many tokens or texts as a worker should hold.
PER_BUCKET = 256
MOST_TOKENS = 1 << 20
MOST_TEXTS = 1 << 14
# Sums of losses travel as whole multiples of 1 / UNIT: fewer bytes, and the same in whatever order they are added.
UNIT = 2.0**32
CODEC = "zstd"


def pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed((before ^ np.uint64(1)) * M1 + word)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before, number of the text, whether another word follows) of every token of the texts."""
    parts = [words(x.lower()) for x in texts]
    sizes = np.array([len(x) for x in parts], np.int64)
    word = word_hashes([w for x in parts for w in x])
    ends = np.cumsum(sizes)
    before, follows = np.roll(word, 1), np.ones(len(word), bool)
    before[(ends - sizes)[sizes > 0]] = START
    follows[(ends - 1)[sizes > 0]] = False
    return word, before, np.repeat(np.arange(len(texts)), sizes), follows


def place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` among the ascending ``keys``; -1 where they are not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Counts:
    """Counts (target, whole) of the frequent words and pairs, ascending by hash, and what all tokens share."""

    words: np.ndarray
    pairs: np.ndarray
    word: np.ndarray = None
    context: np.ndarray = None
    pair: np.ndarray = None
    start: np.ndarray = None
    total: np.ndarray = None
    vocabulary: float = 0.0

    def pair_loss(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        return -np.log(pair + STRENGTH * (word + 1.0) / (self.total + self.vocabulary))


@dataclass
class Models:
    """Both models: the documents (text, target) they count, and the counts of what is frequent."""

    docs: DataFrame
    counts: Counts = field(repr=False)


def _candidates(batches):
    found = [(tokens(utf8(x["text"]))[:2]) for x in batches]
    word = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in found)])
    pair = np.concatenate([np.zeros(0, np.uint64), *(pair_hashes(x[1], x[0]) for x in found)])
    yield pa.record_batch([pa.array([word.tobytes()]), pa.array([pair.tobytes()])], names=["word", "pair"])


def _added(total: np.ndarray, at: np.ndarray, target: np.ndarray) -> None:
    """Adds one per place to the column whole, and to target where the document is one."""
    known = at >= 0
    total[:, 1] += np.bincount(at[known], minlength=len(total))
    total[:, 0] += np.bincount(at[known & target], minlength=len(total))


def _count(batches, counts: Counts):
    nw, np_ = len(counts.words), len(counts.pairs)
    word, context, pair = np.zeros((nw, 2), np.int64), np.zeros((nw, 2), np.int64), np.zeros((np_, 2), np.int64)
    start, total, least = np.zeros((1, 2), np.int64), np.zeros((1, 2), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        w, v, doc, follows = tokens(utf8(batch["text"]))
        target = np.array([bool(x) for x in batch["target"].to_pylist()], bool)[doc]
        at = place(counts.words, w)
        _added(word, at, target)
        _added(context, np.where(follows, at, -1), target)
        _added(pair, place(counts.pairs, pair_hashes(v, w)), target)
        _added(start, np.where(v == START, 0, -1), target)
        _added(total, np.zeros(len(w), np.int64), target)
        low = w[w <= least[-1]] if len(least) == SKETCH else w
        least = np.unique(np.concatenate([least, low]))[:SKETCH]
    made = []
    for kind, sums in enumerate((word, context, pair, start, total)):
        at = np.flatnonzero(sums[:, 1])
        made.append((np.full(len(at), kind), at, sums[at, 0], sums[at, 1]))
    # Hashes in the order of unsigned numbers, as signed ones.
    signed = (least ^ np.uint64(1 << 63)).view(np.int64)
    made.append((np.full(len(least), LEAST), signed, np.zeros(len(least), np.int64), np.zeros(len(least), np.int64)))
    columns = [pa.array(np.concatenate(x), t) for x, t in zip(zip(*made), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
    yield pa.record_batch(columns, names=["kind", "place", "target", "whole"])


def fit(docs: DataFrame) -> Models:
    """Models from (text, target boolean) rows. The counts of rare words and pairs are made where they are asked for."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = docs.count()
    share = min(1.0, SAMPLE_ROWS / n) if n else 0.0
    # By row where rows have ids: else all copies of a text would be drawn together.
    drawn = F.xxhash64("doc_id", "text") if "doc_id" in docs.columns else F.xxhash64("text")
    sample = docs.where(keep_share(drawn, F.lit(share))).select("text")
    found = sample.mapInArrow(_candidates, "word binary, pair binary").toArrow()
    hot = []
    for name in ("word", "pair"):
        seen = np.frombuffer(b"".join(found[name].to_pylist()), np.uint64)
        keys, times = np.unique(seen, return_counts=True)
        hot.append(keys[times >= max(HOT * len(seen), 2)])
    counts = Counts(*hot)
    rows = docs.select("text", "target").mapInArrow(
        functools.partial(_count, counts=counts), "kind int, place long, target long, whole long"
    )
    # Both results are bounded: sums by the frequent words and pairs, hashes by SKETCH. Tasks send as many at most.
    rows = stage(rows, "frequent-counts")
    sums = [np.zeros((k, 2), np.int64) for k in (len(hot[0]), len(hot[0]), len(hot[1]), 1, 1)]
    added = rows.where(F.col("kind") < LEAST).groupBy("kind", "place")
    for r in added.agg(F.sum("target").alias("target"), F.sum("whole").alias("whole")).collect():
        sums[r["kind"]][r["place"]] = r["target"], r["whole"]
    least = rows.where(F.col("kind") == LEAST).select("place").distinct().orderBy("place").limit(SKETCH).collect()
    greatest = (least[-1]["place"] + (1 << 63)) if least else 0
    different = (SKETCH - 1) * 2.0**64 / greatest if len(least) == SKETCH else len(least)
    return Models(docs, Counts(*hot, *sums, max(float(different), 1.0)))


def _packed(bucket: int, keys: np.ndarray, target: np.ndarray, part, sums) -> tuple:
    """One row: hashes of texts, whether each is a target, their tokens (word, before, text, follows), sums per text."""
    word, before, doc, follows = part
    names, local = np.unique(doc, return_inverse=True) if sums is None else (np.arange(len(keys)), doc)
    # Two bytes a token where the texts of a batch are few enough, as they are in bounded batches.
    narrow = np.uint16 if len(names) <= 1 << 15 else np.uint32
    place_ = (local.astype(narrow) << narrow(1)) | follows.astype(narrow)
    return (
        bucket, keys[names].tobytes(), np.packbits(target[names]).tobytes(), word.tobytes(), before.tobytes(),
        place_.tobytes(), b"" if sums is None else sums.tobytes(),
    )


SENT = "bucket int, texts binary, target binary, word binary, before binary, place binary, sums binary"
KINDS = {"texts": np.int64, "word": np.uint64, "before": np.uint64}


def _shrunk(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers without their likeness: first bytes, second bytes and so on, compressed; of ascending ones the differences."""
    if not len(values):
        return b""
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.Codec(CODEC).compress(planes, asbytes=True)


def _grown(data: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec(CODEC).decompress(data[4:], n * size, asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if ascending else values


def _gathered(batches, buckets: int):
    """(row numbers, hashes of texts, targets, tokens) of batches, several as one where they have few tokens for a bucket."""
    held, n_tokens, n_texts = [], 0, 0

    def joined():
        ids, hashes, target, w, v, doc, follows = zip(*held)
        first = np.cumsum([0, *map(len, ids)])
        doc = [x + k for x, k in zip(doc, first)]
        return *map(np.concatenate, (ids, hashes, target)), tuple(map(np.concatenate, (w, v, doc, follows)))

    for batch in batches:
        part = tokens(utf8(batch["text"]))
        ids, hashes = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "text_hash"))
        held.append((ids, hashes, np.array([bool(x) for x in batch["target"].to_pylist()], bool), *part))
        n_tokens, n_texts = n_tokens + len(part[0]), n_texts + len(ids)
        if n_tokens >= min(PER_BUCKET * buckets, MOST_TOKENS) or n_texts >= MOST_TEXTS:
            yield joined()
            held, n_tokens, n_texts = [], 0, 0
    if held:
        yield joined()


def _send(batches, shared, buckets: int, counted: bool, scored: bool):
    """Tokens by bucket, and per text what the frequent words and pairs give."""
    counts: Counts = shared.value
    for keys, hashes, target, (w, v, doc, follows) in _gathered(batches, buckets):
        pair = pair_hashes(v, w)
        at_w, at_p, at_v = place(counts.words, w), place(counts.pairs, pair), place(counts.words, v)
        out = []
        if scored and len(keys):
            sums = np.zeros((len(keys), 4), np.int64)
            sums[:, 0] = hashes
            sums[:, 1] = np.bincount(doc, minlength=len(keys))
            both = (at_p >= 0) & (at_w >= 0)
            started = v == START
            for k in (0, 1):
                loss = np.zeros(len(w))
                loss[both] = counts.pair_loss(counts.pair[at_p[both]], counts.word[at_w[both]])[:, k]
                context = np.where(started, counts.start[0, k], counts.context[at_v, k] if len(counts.words) else 0)
                loss += np.where(started | (at_v >= 0), np.log(context + STRENGTH), 0.0)
                sums[:, 2 + k] = np.rint(np.bincount(doc, loss, minlength=len(keys)) * UNIT)
            nothing = [x[:0] for x in (w, v, doc, follows)]
            out.append(_packed(int(keys[0] % buckets), keys, target, nothing, sums))
        bucket = (np.where(at_w >= 0, pair, mixed(w)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((v, w, bucket))
        order = order[~((at_p >= 0) & (at_w >= 0))[order]]
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows):
                out.append(_packed(int(bucket[rows[0]]), keys, target, [x[rows] for x in (w, v, doc, follows)], None))
        out = [_sent_row(x) for x in out]
        made = [pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*out))]
        if made:
            flags = [pa.array([x] * len(out), pa.bool_()) for x in (counted, scored)]
            yield pa.record_batch([*made, *flags], names=[x.split()[0] for x in SENT.split(", ")] + ["counted", "scored"])


def _sent_row(made: tuple) -> tuple:
    """A row of ``_packed`` as it travels. The width of a place shows in the number of bytes."""
    row = dict(zip((x.split()[0] for x in SENT.split(", ")), made))
    row |= {c: _shrunk(np.frombuffer(row[c], kind), True) for c, kind in KINDS.items()}
    narrow = _place_kind(row["place"], made[3])
    return tuple((row | {"place": _shrunk(np.frombuffer(row["place"], narrow))}).values())


def _place_kind(data: bytes, word: bytes) -> type:
    return np.uint16 if len(data) * 4 == len(word) else np.uint32


def _received(row: dict) -> dict:
    """The row of ``_packed`` again."""
    made = {c: _grown(row[c], kind, True).tobytes() for c, kind in KINDS.items()}
    # Texts are few enough for two bytes where their numbers in the row are.
    narrow = np.uint16 if len(made["texts"]) // 8 <= 1 << 15 else np.uint32
    return row | made | {"place": _grown(row["place"], narrow).tobytes()}


def _numbers(keys: np.ndarray, counted: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, counts (target, whole) by number)."""
    _, number = np.unique(keys, return_inverse=True)
    n = int(number.max()) + 1 if len(number) else 0
    return number, np.stack([np.bincount(number, counted & target, minlength=n), np.bincount(number, counted, minlength=n)], 1)


def _bucket_sums(rows: list[dict], counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of texts, sums of both losses) of the scored tokens of one bucket."""
    parts = []
    for row in rows:
        texts = np.frombuffer(row["texts"], np.int64)
        narrow = _place_kind(row["place"], row["word"])
        at = np.frombuffer(row["place"], narrow)
        doc = (at >> narrow(1)).astype(np.int64)
        target = np.unpackbits(np.frombuffer(row["target"], np.uint8), count=len(texts)).astype(bool)[doc]
        flags = np.full(len(doc), row["counted"]), np.full(len(doc), row["scored"])
        word, before = np.frombuffer(row["word"], np.uint64), np.frombuffer(row["before"], np.uint64)
        parts.append((word, before, texts[doc], (at & narrow(1)).astype(bool), target, *flags))
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, 2))
    w, v, text, follows, target, counted, scored = (np.concatenate(x) for x in zip(*parts))
    hot = place(counts.words, w)
    pair, of_pair = _numbers(pair_hashes(v, w), counted, target)
    word, of_word = _numbers(w, counted, target)
    _, of_context = _numbers(w, counted & follows, target)
    c_word = of_word[word]
    c_word[hot >= 0] = counts.word[hot[hot >= 0]]
    loss = counts.pair_loss(of_pair[pair], c_word)
    loss += np.where((follows & (hot < 0))[:, None], np.log(of_context[word] + STRENGTH), 0.0)
    names, number = np.unique(text[scored], return_inverse=True)
    return names, np.stack([np.bincount(number, loss[scored, k], minlength=len(names)) for k in (0, 1)], 1)


RETURNED = "block long, texts binary, hashes binary, sums binary"


def _returned(texts: np.ndarray, hashes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Sums (whole numbers) of ascending texts, one row per block of texts."""
    block = texts // TEXTS
    rows = []
    for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(block)) + 1):
        if len(at):
            named = _shrunk(hashes[at]) if len(hashes) else b""
            rows.append((int(block[at[0]]), _shrunk(texts[at], True), named, _shrunk(sums[at].T.ravel())))
    made = [pa.array([x[k] for x in rows], pa.int64() if k == 0 else pa.binary()) for k in range(4)]
    return pa.record_batch(made, names=[x.split()[0] for x in RETURNED.split(", ")])


def _add_up(batches, shared):
    """Sums per text within a task; a bucket's rows all lie in it, one after another."""
    keys, sums, rows = [np.zeros(0, np.int64)], [np.zeros((0, 2))], []

    def close():
        made = _bucket_sums(rows, shared.value)
        keys.append(made[0])
        sums.append(made[1])
        rows.clear()

    for batch in batches:
        for row in batch.to_pylist():
            row = _received(row)
            if row["sums"]:
                given = np.frombuffer(row["sums"], np.int64).reshape(-1, 4)
                yield _returned(np.frombuffer(row["texts"], np.int64), given[:, 0], given[:, 1:])
                continue
            if rows and rows[-1]["bucket"] != row["bucket"]:
                close()
            rows.append(row)
    if rows:
        close()
    names, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.concatenate(sums)
    total = np.stack([np.bincount(number, total[:, k], minlength=len(names)) for k in (0, 1)], 1)
    yield _returned(names, names[:0], np.rint(total * UNIT).astype(np.int64))


def _whole(batches):
    """(text_hash, n, docs, a, b) of every text; the rows of a block lie in one task, one after another."""
    block, total, hashes, there = None, None, None, None

    def made():
        n, a, b = total[there].T.astype(float)
        columns = [hashes[there], n, np.ones(len(n)), a / UNIT, b / UNIT]
        return pa.record_batch([pa.array(x) for x in columns], names=["text_hash", *SUMS])

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block:
                if block is not None:
                    yield made()
                block = row["block"]
                total, hashes, there = np.zeros((TEXTS, 3), np.int64), np.zeros(TEXTS, np.int64), np.zeros(TEXTS, bool)
            at = _grown(row["texts"], np.int64, True) - block * TEXTS
            given = _grown(row["hashes"], np.int64)
            sums = _grown(row["sums"], np.int64).reshape(-1, len(at)).T
            total[at, 3 - sums.shape[1] :] += sums
            if len(given):
                hashes[at], there[at] = given, True
    if block is not None:
        yield made()


def score(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(models.counts)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sent(rows: DataFrame, counted: bool, scored: bool) -> DataFrame:
        send = functools.partial(_send, shared=shared, buckets=PER_PARTITION * partitions, counted=counted, scored=scored)
        target = F.col("target") if "target" in rows.columns else F.lit(False)
        number = F.monotonically_increasing_id().alias("row")
        rows = rows.select(number, F.xxhash64("text").alias("text_hash"), "text", target.alias("target"))
        return rows.mapInArrow(send, SENT + ", counted boolean, scored boolean")

    same = docs is models.docs
    tokens_ = sent(docs, True, True) if same else sent(models.docs, True, False).union(sent(docs, False, True))
    dealt = tokens_.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    added = dealt.mapInArrow(functools.partial(_add_up, shared=shared), RETURNED)
    added = added.repartition(partitions, "block").sortWithinPartitions("block")
    added = added.mapInArrow(_whole, "text_hash long, n double, docs double, a double, b double")
    added = added.groupBy("text_hash").agg(*[F.sum(c).alias(c) for c in SUMS])
    # Equal texts are one row: n and the losses are sums over all of them.
    some = F.col("n") > 0
    means = added.select(
        "text_hash",
        F.round(F.col("n") / F.col("docs")).cast("long").alias("n_tokens"),
        F.when(some, F.col("a") / F.col("n")).alias("target_loss"),
        F.when(some, F.col("b") / F.col("n")).alias("background_loss"),
    )
    means = stage(means, "text-losses")
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    joined = salted_join(named, means, ["text_hash"], ["doc_id"], SALTS, fits=fits_broadcast(means, BROADCAST_ROWS))
    return joined.select(
        "doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score")
    )


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, target): target documents are labelled with quality 1. The ids are broadcast where they are few;
    otherwise texts are shuffled."""
    wanted = labels.where("quality = 1").select(F.col("doc_id"), F.lit(True).alias("target")).distinct()
    if fits_broadcast(wanted, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    joined = docs.select("doc_id", "text").join(wanted, "doc_id", "left")
    return joined.withColumn("target", F.coalesce("target", F.lit(False)))


def op7_lm_scoring(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = with_target(docs, labels)
    return score(rows, fit(rows))
