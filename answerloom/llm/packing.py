"""Best-fit packing by a configuration linear program over the length histogram.

A document is its token ids and a closing id 0, cut into pieces of at most ``capacity`` ids. Only the histogram of
piece lengths (at most ``capacity`` numbers, whatever the corpus) reaches the driver. The linear program chooses how
often each configuration (how many pieces of each length share a sequence) is used; it is solved by multiplicative
weights: lengths that are covered get cheaper, a knapsack dynamic program prices configurations, and all those near
the best price are taken by a step. The configurations of best fit decreasing are the first columns. Every round of prices
bounds the optimum from below; once the columns at hand meet that bound no configuration can better them and the
rounds end. Otherwise counts are rounded down, the few pieces left over (bounded by the number of configurations) are
packed best fit decreasing, and the first columns stay if rounding is no better. Spark then gives each
piece its place: its rank among the pieces of its length points into the list of configurations.

Defined cases: null text is empty, an empty document is the single id 0; documents longer than ``capacity`` are cut
and no other is; ties in rank go by doc_id, piece and hash of the ids, and equal rows are packed each; an empty table gives an
empty result; only doc_id and text are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.texts import bounded_batches, ids_crc32, remembers, table, utf8, words
from answerloom.session import stage

CAPACITY = 2048
END = array("I", [0]).tobytes()
WORDS_HELD = 240_000
LONG_WORD = 64
# Marks that are a part of their own behind letters.
MARKS = ".,;:!?"
ROUNDS = 400
STEP = 0.05
NEAR = 0.001
RATE = 10.0
LOOSE = (0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0)
HELD = (0.0, 0.005, 0.02)
ROWS_PER_BUCKET = 20_000


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts, by white-space separated words: the tokenizer's words never span white space, so
    the ids of a text are those of its words in a row. Holds some ``WORDS_HELD`` words, and as many of those used before."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters: dict[str, str] = {}
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [words(x) for x in texts]
        if len(self.known) > WORDS_HELD:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = set()
        for parts in split:
            new.update(parts)
        new.difference_update(known)
        again = new.intersection(before)
        known.update((w, before[w]) for w in again)
        new = list(new - again)
        known.update(self._encoded(new))
        out = [b"".join(map(known.__getitem__, parts)) for parts in split]
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return out

    def _letter(self, c: str) -> str:
        """A letter as the tokenizer's own pre-tokenizer writes it for the model."""
        if c not in self.letters:
            self.letters[c] = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0]
        return self.letters[c]

    def _encoded(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of single words. Normal words of letters, with or without one mark behind, go straight to the
        tokenizer's model, which costs a third of the whole way; all others take the whole way."""
        model, letter = self.tokenizer.model, self._letter
        marks = {m: array("I", self.tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in MARKS}
        done, rest = {}, []
        for w in new:
            x = w.decode("utf-8", "replace")
            mark = marks.get(x[-1], b"")
            plain = x[:-1] if mark else x
            # letter by letter, as the tokenizer does: lower() of a whole word knows a final sigma
            low = plain.lower() if plain.isascii() else "".join(map(str.lower, plain))
            if low.isalpha() and unicodedata.is_normalized("NFC", low):
                if not low.isascii():
                    low = "".join(map(letter, low))
                done[w] = array("I", [t.id for t in model.tokenize(low)]).tobytes() + mark
            else:
                rest.append((w, x))
        encoded = self.tokenizer.encode_batch_fast([x for _, x in rest], add_special_tokens=False)
        done.update((w, array("I", e.ids).tobytes()) for (w, _), e in zip(rest, encoded))
        return done


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


remembers(word_ids.cache_clear)


def _pieces(batches, path: str | None, capacity: int, keep_ids: bool):
    pa.default_memory_pool().release_unused()
    encoder = word_ids(path or public_tokenizer())
    for batch in batches:
        doc, piece, start, length, crc, ids = [], [], [], [], [], []
        for k, data in enumerate(encoder.encode(utf8(batch["text"]))):
            data += END
            for n, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                doc.append(k)
                piece.append(n)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(ids_crc32(part))
                if keep_ids:
                    ids.append(part)
        columns = [batch["doc_id"].take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32())]
        columns += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(ids, pa.binary())] * keep_ids
        yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of (doc_id, text); ``ids`` are little-endian 32-bit numbers."""
    # Words are encoded once per batch, so batches are larger than elsewhere.
    bounded_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(
        functools.partial(_pieces, path=tokenizer, capacity=capacity, keep_ids=keep_ids), schema
    )


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Best price of the pieces within each size up to ``capacity``; ``lengths`` ascend."""
    best = np.zeros(capacity + 1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for size in range(1, capacity + 1):
        k = fitting[size]
        best[size] = max(best[size - 1], (best[size - lengths[:k]] + prices[:k]).max()) if k else best[size - 1]
    return best


def _traced(size: int, best: np.ndarray, lengths: np.ndarray, prices: np.ndarray, left: np.ndarray) -> dict[int, int]:
    """A configuration of at most ``size`` at the best price within ``NEAR``; of the lengths that lead there,
    the one is taken of which most is left."""
    taken: dict[int, int] = {}
    while size > 0:
        n = np.searchsorted(lengths, size, side="right")
        if n == 0:
            break
        near = np.flatnonzero(best[size - lengths[:n]] + prices[:n] >= best[size] * (1 - NEAR))
        if not len(near):
            size -= 1
            continue
        length = int(lengths[near[left[lengths[near]].argmax()]])
        taken[length] = taken.get(length, 0) + 1
        size -= length
    return taken


Uses = dict[tuple[tuple[int, int], ...], float]


def threshold_bound(histogram: dict[int, int], capacity: int) -> float:
    """Sequences that any packing needs: for every t up to half the capacity, pieces of more than capacity - t fill a
    sequence each, pieces below t are left out, and the others count by their length."""
    n = np.zeros(capacity + 1)
    for length, k in histogram.items():
        n[length] = k
    size = np.arange(capacity + 1)
    upto, mass = np.cumsum(n), np.cumsum(n * size)
    t = np.arange(capacity // 2 + 1)
    whole = upto[capacity] - upto[capacity - t]
    below = mass[np.maximum(t - 1, 0)]
    return float((whole + (mass[capacity - t] - below) / capacity).max())


def solve(histogram: dict[int, int], capacity: int = CAPACITY, first: Uses | None = None) -> tuple[Uses, float]:
    """(use, bound): fractional use of configurations, each a sorted tuple of (length, copies), that covers every length,
    and a lower bound of the number of sequences. ``first`` are whole columns to begin with; they are the result once
    the bound shows that they are the optimum.

    Prices over the best price of a configuration are a feasible dual, so their sum over all pieces is a bound."""
    total = np.zeros(capacity + 1)
    for length, n in histogram.items():
        total[length] = n
    left, use = total.copy(), {}
    bound = threshold_bound(histogram, capacity)
    for _ in range(ROUNDS):
        lengths = np.flatnonzero(left > 1e-6)
        if not len(lengths):
            break
        prices = lengths * np.exp(-RATE * (1 - left[lengths] / total[lengths]))
        best = knapsack(lengths, prices, capacity)
        bound = max(bound, float(prices @ total[lengths] / best[capacity]))
        if first is not None and sum(first.values()) <= np.ceil(bound - 1e-6):
            return first, bound
        value = prices + best[capacity - lengths]
        for k in np.argsort(-value, kind="stable"):
            if value[k] < (1 - NEAR) * best[capacity]:
                break
            longest = int(lengths[k])
            if left[longest] <= 1e-6:
                continue
            taken = _traced(capacity - longest, best, lengths, prices, left)
            taken[longest] = taken.get(longest, 0) + 1
            step = min(min(left[x] / a, max(1.0, STEP * total[x] / a)) for x, a in taken.items())
            if step <= 1e-6:
                continue
            for x, a in taken.items():
                left[x] -= step * a
            key = tuple(sorted(taken.items(), reverse=True))
            use[key] = use.get(key, 0.0) + step
    return use, bound


def best_fit(counts: dict[int, int], capacity: int) -> dict[tuple[tuple[int, int], ...], int]:
    """Best fit decreasing in bulk: sequences with equal contents are one entry with a number, so the work depends
    on how many lengths there are and not on how many pieces."""
    rooms: list[dict[tuple[tuple[int, int], ...], int]] = [{} for _ in range(capacity + 1)]
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for room in range(length, capacity):
            if n == 0:
                break
            for key in list(rooms[room]):
                fit = room // length
                full = min(rooms[room][key], n // fit)
                n = _moved(rooms, key, room, length, fit, full, n)
                if full == 0 and n and rooms[room].get(key):
                    n = _moved(rooms, key, room, length, n, 1, n)
                elif n and n < fit and rooms[room].get(key):
                    n = _moved(rooms, key, room, length, n, 1, n)
                if n == 0:
                    break
        fit = capacity // length
        for copies, new in ((fit, n // fit), (n % fit, 1)):
            if copies and new:
                rest = rooms[capacity - copies * length]
                key = ((length, copies),)
                rest[key] = rest.get(key, 0) + new
    use: dict[tuple[tuple[int, int], ...], int] = {}
    for level in rooms:
        for key, n in level.items():
            use[key] = use.get(key, 0) + n
    return use


def _moved(rooms, key, room, length, copies, bins, n) -> int:
    """Put ``copies`` more pieces into each of ``bins`` sequences of one kind; returns the pieces still to place."""
    if bins:
        rooms[room][key] -= bins
        if not rooms[room][key]:
            del rooms[room][key]
        to, new = rooms[room - copies * length], (*key, (length, copies))
        to[new] = to.get(new, 0) + bins
    return n - copies * bins


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[tuple[tuple[int, int], ...], int]:
    """Whole numbers of each configuration that hold every piece exactly once; never more than best fit decreasing.

    Where the first columns are not proven optimal, those that are nearly full are held and the program is solved for
    what the others contain, from all of them down to the loosest."""
    first = best_fit(histogram, capacity)
    found, bound = solve(histogram, capacity, first)
    if found is first:
        return first
    packed = [first, _rounded(histogram, found, capacity)]
    for share in HELD:
        tight = {k: n for k, n in first.items() if capacity - sum(x * a for x, a in k) <= share * capacity}
        rest = dict(histogram)
        for key, n in tight.items():
            for length, a in key:
                rest[length] -= n * a
        rest = {k: n for k, n in rest.items() if n}
        if sum(packed[-1].values()) <= np.ceil(bound - 1e-6) or not rest:
            break
        use = _rounded(rest, solve(rest, capacity)[0], capacity)
        for key, n in tight.items():
            use[key] = use.get(key, 0) + n
        packed.append(use)
    return min(packed, key=lambda x: sum(x.values()))


def _rounded(histogram: dict[int, int], found: Uses, capacity: int) -> dict[tuple[tuple[int, int], ...], int]:
    """Whole uses from fractional ones: rounded down, the rest packed best fit, loose ones packed again."""
    use, left = {}, dict(histogram)
    for key, x in sorted(found.items(), key=lambda kv: -kv[1]):
        n = min(int(x + 1e-6), *(left[length] // a for length, a in key))
        if n > 0:
            use[key] = n
            for length, a in key:
                left[length] -= n * a
    for key, n in best_fit({k: v for k, v in left.items() if v}, capacity).items():
        use[key] = use.get(key, 0) + n
    for share in LOOSE:
        use = _tightened(use, capacity, share)
    return use


def _tightened(use: dict[tuple[tuple[int, int], ...], int], capacity: int, share: float):
    """Repack the configurations with more than ``share`` of their room unused, where that saves sequences."""
    loose = {k: n for k, n in use.items() if capacity - sum(x * a for x, a in k) > share * capacity}
    held: dict[int, int] = {}
    for key, n in loose.items():
        for length, a in key:
            held[length] = held.get(length, 0) + a * n
    packed = best_fit(held, capacity)
    if sum(packed.values()) >= sum(loose.values()):
        return use
    out = {k: n for k, n in use.items() if k not in loose}
    for key, n in packed.items():
        out[key] = out.get(key, 0) + n
    return out


@dataclass
class Slots:
    """Places by (length, rank): slot k serves the ranks from its key on."""

    key: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


RANK_BITS = 44


def slots(use: dict[tuple[tuple[int, int], ...], int]) -> Slots:
    rows, filled, sequence = [], {}, 0
    for key, n in sorted(use.items(), reverse=True):
        offset = 0
        for length, a in key:
            first = filled.get(length, 0)
            rows.append((length << RANK_BITS | first, a, sequence, offset))
            filled[length] = first + a * n
            offset += length * a
        sequence += n
    rows.sort()
    return Slots(*(np.array(x, np.int64) for x in (zip(*rows) if rows else ([], [], [], []))))


def _placed(batches, shared):
    s = shared.value
    for batch in batches:
        length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
        wanted = length << RANK_BITS | rank
        at = np.searchsorted(s.key, wanted, side="right") - 1
        inside = wanted - s.key[at]
        sequence = s.sequence[at] + inside // s.copies[at]
        offset = s.offset[at] + inside % s.copies[at] * length
        kept = [k for k, c in enumerate(batch.schema.names) if c != "rank"]
        columns = [batch.column(k) for k in kept] + [pa.array(sequence), pa.array(offset)]
        yield pa.record_batch(columns, names=[batch.schema.names[k] for k in kept] + ["sequence_id", "offset"])


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (from ``pieces``, stored) with sequence_id and offset.

    Ranks are taken within (length, bucket) and shifted by the counts of the buckets before, so a length that holds
    a third of all pieces is dealt over many tasks.
    """
    spark = made.sparkSession
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(slots(configurations(histogram, capacity)))
    buckets = max(16, -(-sum(histogram.values()) // ROWS_PER_BUCKET))
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    shift = shift.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(shift, ["length", "bucket"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("shift")).cast("bigint")).drop("shift", "bucket")
    ranked = ranked.select(*made.columns, "rank")
    schema = ", ".join(f"`{c}` {t}" for c, t in made.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(functools.partial(_placed, shared=places), schema)


def op1_best_fit_packing(spark, sf_dir):
    return pack(stage(pieces(table(spark, sf_dir, "documents")), "pieces"))
