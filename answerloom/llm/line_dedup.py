r"""Line dedup by a segment-partition edit join.

Lines end at \n and are compared without the white space around them. Two lines of at least ``MIN_CHARS`` code points
are near when their edit distance is at most ``distance``; shorter lines only when they are equal. Lines are cut into
distance + 1 segments, of which a near line holds one unchanged, at a place bounded by the difference of the lengths
and the number of the segment; so each line looks up its segments and those substrings in one index. Candidates
whose character counts differ too much are refused, the others are verified by a banded bit-parallel edit distance.
A class is a connected component; of all occurrences the one with the smallest (doc_id, line number) stays.

Defined cases: null text stays null and is no line; lines of white space only are never removed; of rows with equal
doc_id the one with the least text hash comes first, and equal rows are one document, both changed alike (each keeps
the first occurrence); a null doc_id comes last; very long lines are compared whole; an empty table gives an empty result. Other columns
of the input are kept; names that start with ``_ld_`` are used inside.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.skew import fits_broadcast, salted_join
from answerloom.functions.text import let
from answerloom.llm.linking import link_groups
from answerloom.llm.texts import bounded_batches, strings, table
from answerloom.session import stage

DISTANCE = 2
MIN_CHARS = 10
SALTS = 32
BROADCAST_ROWS = 200_000
BROADCAST_NUMBERS = 4_000_000
SPACES = " \u0009\u000a\u000b\u000c\u000d"
LAST = (1 << 63) - 1


def segments(length: int, distance: int) -> list[tuple[int, int]]:
    """(start, size) of the distance + 1 segments of a line, sizes even to within one, longer ones last."""
    size, longer = divmod(length, distance + 1)
    out, start = [], 0
    for k in range(distance + 1):
        own = size + (k >= distance + 1 - longer)
        out.append((start, own))
        start += own
    return out


@functools.lru_cache(maxsize=4096)
def probes(length: int, distance: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """((indexed length, segment, start, size) of the substrings a line of ``length`` looks up, its own segments first)
    and the number of own segments."""
    own = [(length, k, start, size) for k, (start, size) in enumerate(segments(length, distance))]
    found = list(own)
    for less in range(distance + 1):
        for k, (start, size) in enumerate(segments(length - less, distance)):
            left = max(0, start - k, start + less - (distance - k))
            right = min(length - size, start + k, start + less + (distance - k))
            found += [p for at in range(left, right + 1) if (p := (length - less, k, at, size)) not in own]
    return found, len(own)


def edit_distance_within(a: str, b: str, limit: int) -> int | None:
    """Edit distance of two texts if at most ``limit``: bit-parallel over the 2 * limit + 1 diagonals of the band."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return None
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a:
        return len(b) if len(b) <= limit else None
    # Bit d of a word stands for the cell (row + d - limit, row) of the band; PM has the places of each letter in a.
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    width = 2 * limit + 1
    mask = (1 << width) - 1
    # reach[e]: for every diagonal the last row that e edits reach would be the other classic; here rows advance.
    reached = [0] * (limit + 1)
    # reached[e] has bit d set if b[:row] can be turned into a[:row + d - limit] with at most e edits.
    for e in range(limit + 1):
        for d in range(limit, limit + e + 1):
            reached[e] |= 1 << d
    inside = len(a)
    for row, c in enumerate(b, 1):
        # equal: bit d set if a[row + d - limit - 1] == c
        shift = row - limit - 1
        letters = places.get(c, 0)
        equal = (letters >> shift if shift >= 0 else letters << -shift) & mask
        high = inside - row + limit  # the last diagonal inside a
        low = limit - row  # the first diagonal inside a
        valid = mask & ((1 << high + 1) - 1 if high >= 0 else 0)
        if low > 0:
            valid &= ~((1 << low) - 1)
        before = reached
        reached = []
        for e in range(limit + 1):
            now = before[e] & equal
            if e:
                now |= before[e - 1]  # substitution, same diagonal
                now |= before[e - 1] >> 1  # a letter of b too many
                now |= reached[e - 1] << 1  # a letter of a too many
            reached.append(now & valid)
        if not reached[limit]:
            return None
    last = len(a) - len(b) + limit
    return next((e for e in range(limit + 1) if reached[e] >> last & 1), None)


def _keys(batches, distance: int):
    """Once per batch and line: length, two signatures and the hashed keys, own segments first."""
    for batch in batches:
        lines = dict(zip(batch["id"].to_pylist(), strings(batch["line"])))
        if not lines:
            continue
        data = [x.encode("utf-32-le") for x in lines.values()]
        codes = np.frombuffer(b"".join(data), np.uint32).astype(np.uint64)
        sizes = np.array([len(x) // 4 for x in data])
        starts = np.cumsum(sizes) - sizes
        one = np.uint64(1)
        spread = lambda x: one << ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        letters = np.bitwise_xor.reduceat(spread(codes), starts)
        pairs = spread(codes[:-1] * np.uint64(0x10FFFF) + codes[1:])
        pairs = np.append(pairs, np.uint64(0))
        pairs[starts[1:] - 1] = 0  # not across two lines
        pairs = np.bitwise_xor.reduceat(pairs, starts)
        keys = []
        for x, n in zip(data, sizes.tolist()):
            found, _ = probes(n, distance)
            keys.append([xxhash.xxh3_64_intdigest(x[4 * s : 4 * (s + z)], n0 * 8 + k) - (1 << 63) for n0, k, s, z in found])
        yield pa.record_batch(
            [
                pa.array(list(lines), pa.int64()),
                pa.array(sizes, pa.int32()),
                pa.array(letters.view(np.int64)),
                pa.array(pairs.view(np.int64)),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["id", "n", "letters", "pairs", "keys"],
        )


def _verified(batches, distance: int):
    for batch in batches:
        near = [
            edit_distance_within(x, y, distance) is not None for x, y in zip(batch["ta"].to_pylist(), batch["tb"].to_pylist())
        ]
        yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(near, pa.bool_()))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, h, pos, line, id): every line with more than white space; ``h`` is the hash of the text."""
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64("text").alias("h"),
        F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"),
    )
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).where("line <> ''")
    return lines.withColumn("id", F.xxhash64("line"))


def near_components(lines: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, component) of the distinct lines that have a near one."""
    bounded_batches(lines.sparkSession, 5000)
    long = lines.where(F.length("line") >= max(min_chars, distance + 1)).select("id", "line")
    made = stage(
        long.mapInArrow(
            functools.partial(_keys, distance=distance), "id long, n int, letters long, pairs long, keys array<long>"
        ),
        "line-keys",
    )
    rows = made.select("id", F.posexplode("keys").alias("at", "key"))
    common = (
        rows.groupBy("key")
        .agg(F.min("at").alias("at"), F.min("id").alias("low"), F.max("id").alias("high"))
        .where((F.col("at") <= distance) & (F.col("low") != F.col("high")))
        .select("key")
    )
    common = stage(common, "shared-segments")
    fits = fits_broadcast(common, BROADCAST_ROWS)
    shared = F.broadcast(common) if fits else common
    live = made.select("id", "n", "letters", "pairs", F.posexplode("keys").alias("at", "key")).drop("at")
    live = stage(live.join(shared, "key", "left_semi").distinct(), "shared-lines")
    wanted = stage(live.select("id").distinct(), "wanted-lines")
    texts = salted_join(
        lines.select("id", "line", "doc"), wanted, ["id"], ["doc"], SALTS, "left_semi", fits_broadcast(wanted, BROADCAST_ROWS)
    )
    texts = stage(texts.select("id", "line").dropDuplicates(["id"]), "line-texts")

    def compatible(x, y):
        c = lambda t, name: F.col(f"{t}.{name}")
        differ = lambda name: F.bit_count(c(x, name).bitwiseXOR(c(y, name)))
        return (
            (F.abs(c(x, "n") - c(y, "n")) <= distance)
            & (differ("letters") <= 2 * distance)
            & (differ("pairs") <= 4 * distance)
        )

    def verify(pairs):
        a = texts.select(F.col("id").alias("a"), F.col("line").alias("ta"))
        b = texts.select(F.col("id").alias("b"), F.col("line").alias("tb"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
        return both.mapInArrow(functools.partial(_verified, distance=distance), "a long, b long")

    _, found = link_groups(live, ["key"], ["n", "letters", "pairs"], F.col("id"), compatible, verify)
    return stage(found, "line-components")


def removed_lines(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, h, gone): for each document the numbers of the lines that are not the first of their class."""
    lines = lines_of(docs.select("doc_id", "text"))
    places = stage(lines.select("id", "doc", "h", "pos"), "line-places")
    found = near_components(lines, distance, min_chars)
    first = places.groupBy("id").agg(
        F.min(F.struct("doc", "h", "pos")).alias("first"), F.max(F.struct("doc", "h", "pos")).alias("last")
    )
    classed = first.join(found, "id", "left")
    near = classed.where("component is not null")
    best = near.groupBy("component").agg(F.min("first").alias("keep"))
    repeated = classed.where("component is null and first <> last").select("id", F.col("first").alias("keep"))
    multiple = stage(near.join(best, "component").select("id", "keep").union(repeated), "repeated-lines")
    hit = salted_join(places, multiple, ["id"], ["doc", "pos"], SALTS, fits=fits_broadcast(multiple, BROADCAST_ROWS))
    gone = hit.where(F.struct("doc", "h", "pos") != F.col("keep"))
    return gone.groupBy("doc", "h").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines removed from ``text``; all columns and all rows stay."""
    gone = stage(removed_lines(docs, distance, min_chars), "gone")
    gone = gone.select(F.col("doc").alias("_ld_doc"), F.col("h").alias("_ld_h"), F.col("gone").alias("_ld_gone"))
    numbers = gone.agg(F.sum(F.size("_ld_gone"))).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS and fits_broadcast(gone, BROADCAST_ROWS):
        gone = F.broadcast(gone)
    here = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))
    joined = docs.join(gone, (here == F.col("_ld_doc")) & (F.xxhash64(docs["text"]) == F.col("_ld_h")), "left")
    kept = let(
        F.split("text", "\n"),
        lambda lines: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_gone")), lambda k: F.get(lines, k)
            ),
            "\n",
        ),
    )
    text = F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op5_line_dedup(spark, sf_dir):
    """Per document the lines and code points before and after, and the hash of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    count = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, "\n"))).cast("long")
    size = lambda c: F.length(F.coalesce(c, F.lit(""))).cast("long")
    out = dedup_lines(docs)
    return out.select(
        "doc_id",
        count(F.col("before")).alias("n_lines"),
        count(F.col("text")).alias("n_lines_kept"),
        size(F.col("before")).alias("n_chars"),
        size(F.col("text")).alias("n_chars_kept"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
