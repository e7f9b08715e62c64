r"""Periodic runs by a grammar.

The word ids of a batch of texts are compressed by Re-Pair: a pair of neighbouring symbols that occurs twice or more
becomes a symbol of its own, until no pair repeats. Pairs are replaced in rounds: all occurrences that are more frequent
than the pairs they overlap go at once. What is left of each text is joined two by two, so every text is one binary
tree, and equal parts of texts are one symbol. A run lies across the middle of the smallest symbol that holds it. So the
runs across the middle of each symbol are computed once, at one of its places, and carried to all places where
the symbol stands; of intervals with one period only the maximal ones stay.

A run of at least four periods across a middle has two of them on one side. Periods are therefore those where the words
right (or left) of the middle repeat at once; candidates agree in four words, and are extended as far as the symbol
goes by hashes of prefixes. Every run that is reported was compared word by word.

A run is a stretch with smallest period q of at least max(``MIN_WORDS``, ``MIN_TIMES`` * q) words that no neighbouring
word extends with that period. ``collapse`` keeps the first q words of each run.

Defined cases: words are ``[^\x20\x09-\x0D]+``; null and empty texts have no words and no runs; very long texts are
one row and take memory in proportion; rows that repeat are worked each; of runs with equal exponent the first and shortest
period counts as best; a null doc_id counts as an empty id in the query's own edit; an empty table gives an empty result.
Other columns pass through; outputs replace columns of their name.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.functions.text import let
from answerloom.llm.texts import M1, bounded_batches, crc32_of_id, mixed, table, utf8, words

MIN_WORDS = 6
MIN_TIMES = 4
PROBES = 1 << 21
PREFIX = 4


class Grammar:
    """Symbols of two parts over the words of many texts. ``low``, ``middle`` and ``high`` place one occurrence of each
    symbol in the words; ``symbol`` and ``at`` list every occurrence."""

    def __init__(self, ids: np.ndarray, text: np.ndarray):
        self.low, self.middle, self.high, self.symbol, self.at = ([] for _ in range(5))
        self.made = 0
        self._letters = int(ids.max()) + 1 if len(ids) else 0
        self._replace_pairs(ids.astype(np.int64), text)
        self.low, self.middle, self.high, self.symbol, self.at = (
            np.concatenate(x) if x else np.zeros(0, np.int64)
            for x in (self.low, self.middle, self.high, self.symbol, self.at)
        )

    def _replace_pairs(self, symbol: np.ndarray, text: np.ndarray) -> None:
        n = len(symbol)
        start = np.arange(n + 1)  # word where each symbol begins, and the end of all
        live = np.ones(n, bool)  # a pair that begins here may occur elsewhere
        while True:
            here = np.flatnonzero(live[:-1] & (text[:-1] == text[1:]))
            if not len(here):
                break
            key = symbol[here] << 32 | symbol[here + 1]
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[True], np.diff(key[order]) != 0])
            group = np.empty(len(here), np.int64)
            group[order] = np.cumsum(new) - 1
            count = np.bincount(group)
            often = count[group] >= 2
            live[:-1] = False
            here, group, key = here[often], group[often], key[often]
            if not len(here):
                break
            live[here] = True
            # Rank of a pair: its frequency in powers of two, then a hash of it, so that chains of ranks stay short.
            rank = np.zeros(len(symbol) + 1, np.uint64)
            level = np.log2(count[group]).astype(np.uint64) << np.uint64(58)
            rank[here] = level | mixed(key.astype(np.uint64)) >> np.uint64(6) | np.uint64(1)
            before = np.concatenate([[np.uint64(0)], rank[:-2]])
            behind = rank[1:]
            rank = rank[:-1]
            # A stretch of one symbol has equal ranks: every second of its places counts.
            first = rank != before
            first[0] = True
            begin = np.maximum.accumulate(np.where(first, np.arange(len(rank)), 0))
            end = np.append(begin[1:] != begin[:-1], True)
            low_left = np.where(first, before < rank, False)
            low_right = np.where(end, behind < rank, False)
            stretch = np.cumsum(first) - 1
            good = low_left[first][stretch] & low_right[end][stretch]
            taken = np.flatnonzero(good & ((np.arange(len(rank)) - begin) % 2 == 0) & (rank > 0))
            symbol, start, text, live = self._join(symbol, start, text, live, taken, shared=True)
        while len(symbol) > 1:
            same = np.concatenate([[False], text[1:] == text[:-1]])
            begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(text))))
            odd = (np.arange(len(text)) - begin) % 2 == 1
            taken = np.flatnonzero(odd) - 1
            if not len(taken):
                break
            symbol, start, text, live = self._join(symbol, start, text, live, taken, shared=False)

    def _join(self, symbol, start, text, live, taken, shared: bool):
        """Make one symbol of each pair that begins at ``taken``; equal pairs get the same one if ``shared``."""
        if shared:
            _, one, name = np.unique(symbol[taken] << 32 | symbol[taken + 1], return_index=True, return_inverse=True)
        else:
            one = name = np.arange(len(taken))
        example = taken[one]
        self.low.append(start[example])
        self.middle.append(start[example + 1])
        self.high.append(start[example + 2])
        self.symbol.append(self.made + name)
        self.at.append(start[taken])
        symbol[taken] = self._letters + self.made + name
        self.made += len(one)
        # Only pairs with a new symbol can have become frequent.
        live[taken] = True
        live[taken[taken > 0] - 1] = True
        keep = np.ones(len(symbol), bool)
        keep[taken + 1] = False
        return symbol[keep], start[np.append(keep, True)], text[keep], live[keep]


def _prefix_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of words times powers, by which equal stretches are found; and the powers."""
    power = np.full(len(ids) + 1, M1 | np.uint64(1), np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    return sums, power


def _equal_right(sums, power, x, q, room):
    """How many words from x on equal those q further on, at most ``room``."""
    known = np.zeros_like(x)
    step = 1 << max(int(room.max(initial=0)).bit_length() - 1, 0)
    while step:
        to = known + step
        fits = to <= room
        to = np.where(fits, to, known)
        a = (sums[x + to] - sums[x]) * power[q]
        known = np.where(fits & (a == sums[x + q + to] - sums[x + q]), to, known)
        step >>= 1
    return known


def _equal_left(sums, power, x, q, room):
    """How many words before x equal those q further on, at most ``room``."""
    known = np.zeros_like(x)
    step = 1 << max(int(room.max(initial=0)).bit_length() - 1, 0)
    while step:
        to = known + step
        fits = to <= room
        to = np.where(fits, to, known)
        a = (sums[x] - sums[x - to]) * power[q]
        known = np.where(fits & (a == sums[x + q] - sums[x + q - to]), to, known)
        step >>= 1
    return known


def _windows(ids: np.ndarray) -> np.ndarray:
    """A hash of the ``PREFIX`` words from each place on."""
    own = mixed(ids.astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(ids) + PREFIX, np.uint64)
    total[: len(ids)] = own
    out = np.zeros(len(ids), np.uint64)
    for k in range(PREFIX):
        out = (out ^ total[k : k + len(ids)]) * M1
        out ^= out >> np.uint64(29)
    return out


def _blocks(sizes: np.ndarray, limit: int):
    """Slices of rows whose sizes add up to about ``limit``."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield slice(at, to)
        at = to


def middle_runs(ids: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray):
    """(node, start, end, period) of the runs across the middle of [low, high), as far as they lie inside."""
    sums, power = _prefix_hashes(ids)
    window = _windows(ids)
    found = [np.zeros((4, 0), np.int64)]
    for side, room in (("right", high - middle), ("left", middle - low)):
        most = room // 2
        for part in _blocks(most, PROBES):
            node = np.repeat(np.arange(part.start, part.stop), most[part])
            q = np.arange(len(node)) - np.repeat(np.cumsum(most[part]) - most[part], most[part]) + 1
            m = middle[node]
            # A square that begins (or ends) at the middle: compare its first words, four where the period has so many.
            wide = q >= PREFIX
            if side == "right":
                same = np.where(wide, window[m] == window[np.where(wide, m + q, m)], ids[m] == ids[m + q])
            else:
                back = np.where(wide, m - q - PREFIX, m)
                same = np.where(wide, window[np.where(wide, m - PREFIX, m)] == window[back], ids[m - 1] == ids[m - q - 1])
            at = np.flatnonzero(same)
            node, q, m = node[at], q[at], m[at]
            x = m if side == "right" else m - q
            right = _equal_right(sums, power, x, q, high[node] - x - q)
            left = _equal_left(sums, power, x, q, x - low[node])
            start, end = x - left, x + right + q
            long = (end - start >= np.maximum(MIN_WORDS, MIN_TIMES * q)) & (start < m) & (end > m)
            found.append(np.stack([node[long], start[long], end[long], q[long]]))
    node, start, end, q = np.concatenate(found, axis=1)
    order = np.lexsort([q, end, start, node])
    node, start, end, q = node[order], start[order], end[order], q[order]
    # The same stretch has the multiples of its period too.
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[new], start[new], end[new], q[new]


def _exact(ids, low, middle, high, node, start, end, q):
    """The same runs with words instead of hashes; where a hash has misled, the stretch is found word by word."""
    out = []
    for k, s, e, p in zip(node.tolist(), start.tolist(), end.tolist(), q.tolist()):
        if not np.array_equal(ids[s : e - p], ids[s + p : e]):
            m, lo, hi = int(middle[k]), int(low[k]), int(high[k])
            x = m if m + p < hi and ids[m] == ids[m + p] else m - p
            s = e = x
            while s > lo and ids[s - 1] == ids[s - 1 + p]:
                s -= 1
            while e + p < hi and ids[e] == ids[e + p]:
                e += 1
            e += p
            if e - s < max(MIN_WORDS, MIN_TIMES * p):
                continue
        out.append((k, s, e, p))
    return np.array(out, np.int64).reshape(-1, 4).T


def runs_of_batch(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, in words of the whole batch, by start and period. ``text`` ascends and tells
    which text a word is of."""
    if len(ids) < MIN_WORDS:
        return (np.zeros(0, np.int64),) * 3
    grammar = Grammar(ids, text)
    large = np.flatnonzero(grammar.high - grammar.low >= MIN_WORDS)
    low, middle, high = grammar.low[large], grammar.middle[large], grammar.high[large]
    node, start, end, q = _exact(ids, low, middle, high, *middle_runs(ids, low, middle, high))
    if not len(node):
        return (np.zeros(0, np.int64),) * 3
    # Carry the runs of a symbol to every place where it stands.
    by = np.argsort(grammar.symbol, kind="stable")
    symbols = grammar.symbol[by]
    left = np.searchsorted(symbols, large[node], side="left")
    copies = np.searchsorted(symbols, large[node], side="right") - left
    which = np.repeat(np.arange(len(node)), copies)
    place = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(left, copies)
    shift = grammar.at[by][place] - low[node[which]]
    start, end, q = start[which] + shift, end[which] + shift, q[which]
    # Maximal intervals of each period: an interval inside another one is only the part that a smaller symbol saw.
    order = np.lexsort([-end, start, q])
    start, end, q = start[order], end[order], q[order]
    seen = np.maximum.accumulate(q * (len(ids) + 1) + end)
    keep = np.ones(len(q), bool)
    keep[1:] = (q[1:] * (len(ids) + 1) + end[1:]) > seen[:-1]
    start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort([q, start])
    return start[order], end[order], q[order]


def numbered(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each different word, and the text of each word."""
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for p in parts for w in p), np.int64)
    return ids, np.repeat(np.arange(len(parts)), [len(p) for p in parts])


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _found(batches, position: int, kept: list[int], collapse: bool):
    for batch in batches:
        parts = [words(x) for x in utf8(batch.column(position))]
        ids, text = numbered(parts)
        start, end, q = runs_of_batch(ids, text)
        first = np.cumsum([0, *map(len, parts)])
        of = text[start] if len(start) else start
        counts = np.bincount(of, minlength=len(parts))
        runs = pa.StructArray.from_arrays(
            [pa.array(start - first[of]), pa.array(end - start), pa.array(q)], names=["start", "length", "period"]
        )
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        made = {"n_words": pa.array(np.diff(first)), "runs": pa.ListArray.from_arrays(offsets, runs)}
        if collapse:
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, start + q, 1)
            np.add.at(change, end, -1)
            gone = np.cumsum(change)[:-1] > 0
            cut = set(of.tolist())
            texts = [
                b" ".join([w for w, x in zip(p, gone[first[k] : first[k + 1]].tolist()) if not x] if k in cut else p)
                for k, p in enumerate(parts)
            ]
            made["collapsed"] = pa.array(texts, pa.binary()).cast(pa.string())
        columns = [batch.column(k) for k in kept] + list(made.values())
        yield pa.record_batch(columns, names=[batch.schema.names[k] for k in kept] + list(made))


def find_runs(docs: DataFrame, collapse: bool = False) -> DataFrame:
    """``docs`` without ``text``, with n_words, ``runs`` (start, length, period in words, by start and period) and, if
    asked for, ``collapsed``: the words joined by one space, each run cut to its first period."""
    bounded_batches(docs.sparkSession)
    made = ["n_words", "runs"] + ["collapsed"] * collapse
    position = docs.columns.index("text")
    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in ("text", *made)]
    schema = [docs.schema[k] for k in kept] + [T.StructField("n_words", T.LongType()), T.StructField("runs", RUN)]
    schema += [T.StructField("collapsed", T.StringType())] * collapse
    return docs.mapInArrow(functools.partial(_found, position=position, kept=kept, collapse=collapse), T.StructType(schema))


def best_run(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; ties go to the smallest start, then period."""
    return F.reduce(
        runs,
        F.lit(None).cast(RUN.elementType),
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )


def repeated_edit(text: Column, key: Column) -> Column:
    """The contract's edit: where ``key`` is a multiple of ten, the words from one on repeat with one period."""
    g = F.floor(key / 10)

    def repeated(parts: Column) -> Column:
        n = F.size(parts).cast("long")
        edit = lambda a: let(
            1 + F.floor((n - a) / (3 + g % 8)),
            lambda p: F.transform(
                parts, lambda w, i: F.when(i >= a, F.get(parts, (a + (i - a) % p).cast("int"))).otherwise(w)
            ),
        )
        return F.when(n > 0, F.array_join(let(g % F.greatest(n, F.lit(1)), edit), " "))

    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(key % 10 == 0, F.coalesce(let(parts, repeated), text)).otherwise(text)


def op13_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", repeated_edit(F.col("text"), crc32_of_id()).alias("text"))
    found = find_runs(docs, collapse=True).withColumn("best", best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
