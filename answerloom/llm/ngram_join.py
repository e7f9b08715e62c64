r"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct word n-grams (A-Z lower-cased, words ``[^\x20\x09-\x0D]+``). The tokens of every
set are put in one order, rare ones first, and the prefix is what two sets with the wanted overlap cannot both miss.
Equal sets are one set; sets with the same prefix and size are one group. Groups that share a prefix token are
candidates; their members are expanded, filtered by size and by position in the prefix, and verified on
the whole sets. ``linking`` finds components without all pairs of near copies.

Tokens come in the order of their document frequency as far as it stands out: documents are counted in 2**21 hashed cells of
tokens, and what exceeds the mean cell by a power of two goes behind the rest; among equals a token is as rare as its rarest word,
counted in 2**20 cells. So a passage that many documents share stands behind what only copies share. The order decides only
how many candidates there are; the result is exact for any order (up to equal 64-bit hashes of different n-grams).
Candidates are compared by 512 parities of their sets, whose difference is at most that of the sets (the first 256
already where they meet); only for those that pass are the texts read again and the sets intersected.

Defined cases: with fewer words than n the whole sequence is the one n-gram; null texts and texts without words have an
empty set and no links; a null doc_id takes part in links, but never becomes a component's name unless the component
has no other; repeated rows are returned each; an empty table gives an empty result; ``threshold`` is in per cent,
1 to 100, and compared in whole numbers, so ties count as links. Only doc_id and text are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.skew import dealt, fits_broadcast, salted_join
from answerloom.llm.linking import link_groups
from answerloom.llm.texts import bounded_batches, free_name, shingle_hashes, table, utf8, word_hashes, words
from answerloom.session import stage

SIZE = 3
PERCENT = 90
CELL_BITS = 20
CELLS = 1 << CELL_BITS
TOKEN_BITS = 21
TOKEN_CELLS = 1 << TOKEN_BITS
WORDS64 = 8
EARLY64 = 4
CHUNKS = 256
BROADCAST_ROWS = 200_000
SALTS = 32


def token_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    return np.unique(shingle_hashes(word_hashes(words(text.lower())), size))


def _cells(hashes: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def rarity(hashes: np.ndarray, tokens: np.ndarray, size: int, counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """For each window of words (``tokens`` are their hashes) a number that is smaller for rarer ones."""
    width = min(len(hashes), size)
    n = len(hashes) - width + 1
    of_word = counts[_cells(hashes)]
    rarest = functools.reduce(np.minimum, [of_word[k : k + n] for k in range(width)])
    return levels[_cells(tokens, TOKEN_BITS)].astype(np.int64) << 32 | rarest


def levels_of(cells: np.ndarray) -> np.ndarray:
    """By how many powers of two a cell exceeds twice the mean; 0 for all that do not."""
    noise = 2 * max(cells.mean(), 1.0)
    return np.log2(np.maximum(cells / noise, 1.0)).astype(np.int8)


def parities(tokens: np.ndarray) -> bytes:
    """Bit k: whether the tokens of class k are odd in number. Sets that differ in d tokens differ in d bits at most."""
    return np.packbits(np.bincount((tokens >> np.uint64(55)).astype(np.int64), minlength=64 * WORDS64) & 1).tobytes()


def _count_cells(batches, size: int):
    """How often words of each cell occur (32 bits), and in how many documents the tokens of each cell do (16 bits; a cell
    that is full in one task is frequent whatever it would have reached)."""
    of_words, of_tokens = np.zeros(CELLS, np.int32), np.zeros(TOKEN_CELLS, np.int32)
    for batch in batches:
        for text in utf8(batch["text"]):
            hashes = word_hashes(words(text.lower()))
            cells, n = np.unique(_cells(hashes), return_counts=True)
            of_words[cells] += n.astype(np.int32)
            tokens = np.unique(shingle_hashes(hashes, size))
            cells, n = np.unique(_cells(tokens, TOKEN_BITS), return_counts=True)
            of_tokens[cells] += n.astype(np.int32)
    if of_words.any():
        parts = [*of_words.reshape(CHUNKS, -1), *of_tokens.clip(max=0xFFFF).astype(np.uint16).reshape(CHUNKS, -1)]
        yield pa.record_batch(
            [pa.array(range(2 * CHUNKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["chunk", "counts"]
        )


def _sum_cells(batches):
    """Sums per chunk within a task; a chunk's rows all lie in it."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist()):
            totals[chunk] = totals.get(chunk, 0) + np.frombuffer(counts, np.int32 if chunk < CHUNKS else np.uint16).astype(np.int64)
    yield pa.record_batch(
        [pa.array(list(totals), pa.int32()), pa.array([_short(c, x).tobytes() for c, x in totals.items()], pa.binary())],
        names=["chunk", "counts"],
    )


def _short(chunk: int, counts: np.ndarray) -> np.ndarray:
    """What the driver gets: counts of words, and eighths of powers of two for tokens."""
    return _int32(counts) if chunk < CHUNKS else np.round(8 * np.log2(1 + counts)).clip(max=255).astype(np.uint8)


def _int32(counts: np.ndarray) -> np.ndarray:
    """Counts for an order: those beyond 32 bits are equally frequent."""
    return counts.clip(max=np.iinfo(np.int32).max).astype(np.int32)


def cell_counts(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each cell in all texts, and documents with tokens of each cell; 6 MB whatever the corpus."""
    bounded_batches(docs.sparkSession)
    schema = "chunk int, counts binary"
    parts = docs.select("text").mapInArrow(functools.partial(_count_cells, size=size), schema)
    rows = parts.repartition("chunk").mapInArrow(_sum_cells, schema).toArrow()
    of_words, of_tokens = (np.zeros((CHUNKS, n // CHUNKS)) for n in (CELLS, TOKEN_CELLS))
    for chunk, counts in zip(rows["chunk"].to_pylist(), rows["counts"].to_pylist()):
        if chunk < CHUNKS:
            of_words[chunk] += np.frombuffer(counts, np.int32)
        else:
            of_tokens[chunk - CHUNKS] += 2 ** (np.frombuffer(counts, np.uint8) / 8) - 1
    return of_words.reshape(-1), of_tokens.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which two sets of this size or larger share one if their Jaccard index reaches ``percent``."""
    return n - -(-percent * n // 100) + 1


def _prefixes(batches, shared, size: int, percent: int):
    counts, levels = shared.value
    for batch in batches:
        n, ids, prefixes, signs = [], [], [], []
        for text in utf8(batch["text"]):
            hashes = word_hashes(words(text.lower()))
            windows = shingle_hashes(hashes, size)
            tokens, first = np.unique(windows, return_index=True)
            n.append(len(tokens))
            signs.append(parities(tokens))
            if not len(tokens):
                ids.append(None)
                prefixes.append([])
                continue
            ids.append(xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63))
            # tokens ascend, so a stable sort by count breaks ties by hash
            order = np.argsort(rarity(hashes, windows, size, counts, levels)[first], kind="stable")
            prefixes.append(tokens[order[: prefix_length(len(tokens), percent)]].view(np.int64))
        signs = np.frombuffer(b"".join(signs), np.int64).reshape(-1, WORDS64)
        made = [pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
        made += [pa.array(signs[:, k]) for k in range(WORDS64)]
        names = ["doc_id", "text_hash", "n", "id", "prefix", *(f"p{k}" for k in range(WORDS64))]
        yield pa.record_batch([batch["doc_id"], batch["text_hash"], *made], names=names)


def _sets(batches, size: int):
    for batch in batches:
        sets = [token_set(x, size).view(np.int64) for x in utf8(batch["text"])]
        yield pa.record_batch([batch["id"], pa.array(sets, pa.list_(pa.int64()))], names=["id", "tokens"])


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, tokens) of the sets named by ``wanted`` (text_hash, id): their texts are read again, so sets of
    documents without candidates are never stored."""
    bounded_batches(docs.sparkSession)
    named = docs.select(F.col("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = salted_join(named, wanted, ["text_hash"], ["doc_id"], SALTS, fits=fits_broadcast(wanted, BROADCAST_ROWS))
    made = found.select("id", "text").mapInArrow(functools.partial(_sets, size=size), "id long, tokens array<long>")
    return stage(made.dropDuplicates(["id"]), "sets")


def jaccard_filter(docs: DataFrame, sets: DataFrame, size: int, percent: int):
    """A function that keeps the pairs (a, b) of ``sets`` (id, text_hash, n, parities) that reach the threshold."""
    signs = [f"p{k}" for k in range(WORDS64)]

    def side(name: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ["n", *signs]])

    def verify(pairs: DataFrame) -> DataFrame:
        differ = functools.reduce(
            lambda x, y: x + y, [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in signs]
        )
        # |x - y| + |y - x| = |x| + |y| - 2 both, and both >= percent / (100 + percent) * (|x| + |y|)
        most = (100 - percent) * (F.col("a_n") + F.col("b_n"))
        close = pairs.join(side("a"), "a").join(side("b"), "b").where((100 + percent) * differ <= most)
        close = stage(close.select("a", "b"), "close-pairs")
        named = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = stage(sets.select("text_hash", "id").join(named, "id", "left_semi"), "wanted")
        content = sets_of(docs, wanted.select("text_hash", "id"), size)
        a = content.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
        b = content.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb")).cast("long")
        union = F.size("ta") + F.size("tb") - both
        return close.join(dealt(a), "a").join(dealt(b), "b").where(100 * both >= percent * union).select("a", "b")

    return verify


def linked_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, components): rows (doc_id, text_hash, n, id) with the id of their set, stored; links (a, b) between sets that
    join the components; components (id, component) of sets with any link."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts, cells = cell_counts(docs, size)
    shared = spark.sparkContext.broadcast((_int32(counts), levels_of(cells)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(
        docs.withColumn("text_hash", F.xxhash64("text"))
        .select("doc_id", "text_hash", "text")
        .mapInArrow(
            functools.partial(_prefixes, shared=shared, size=size, percent=percent),
            f"doc_id {kind}, text_hash long, n long, id long, prefix array<long>" + "".join(f", p{k} long" for k in range(WORDS64)),
        ),
        "prefixes",
    )
    sets = rows.where("id is not null").dropDuplicates(["id"])
    signs = [f"p{k}" for k in range(WORDS64)]
    sets = stage(sets.select("id", "text_hash", "n", F.xxhash64("prefix", "n").alias("grp"), "prefix", *signs), "sets")
    early = signs[:EARLY64]
    members = sets.select("grp", "id", F.col("n").cast("int"), *early)
    grouped = members.groupBy("grp").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    # One row per group and prefix token; what no other group has is dropped at once.
    heads = sets.join(grouped.select("grp", "id"), ["grp", "id"], "left_semi")
    tokens = heads.select("grp", F.posexplode("prefix").alias("pos", "bucket"))
    common = tokens.groupBy("bucket").agg(F.count("*").alias("groups")).where("groups > 1").select("bucket")
    live = stage(tokens.join(dealt(common), "bucket", "left_semi"), "shared-tokens")
    own = grouped.where("size > 1").select("grp", F.lit(0).alias("pos"), F.col("grp").alias("bucket"))
    expanded = stage(live.union(own.select(*live.columns)).join(members, "grp").drop("grp"), "members")

    def compatible(x, y):
        nx, ny, px, py = (F.col(f"{t}.{c}").cast("long") for c in ("n", "pos") for t in (x, y))
        sizes = (100 * nx >= percent * ny) & (100 * ny >= percent * nx)
        most = F.least(nx - px, ny - py)  # holds at the first token both share, where the pair is found
        differ = [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in early]
        close = (100 + percent) * functools.reduce(lambda a, b: a + b, differ) <= (100 - percent) * (nx + ny)
        return sizes & ((100 + percent) * most >= percent * (nx + ny)) & close

    verify = jaccard_filter(docs, sets, size, percent)
    links, found = link_groups(expanded, ["bucket"], ["n", "pos", *early], F.col("pos"), compatible, verify)
    return rows.select("doc_id", "text_hash", "n", "id"), links, found


def components_of(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row; component_id is the smallest doc_id that links reach."""
    rows, _, found = linked_components(docs, size, percent)
    least = rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = least.join(stage(found, "components"), "id", "left")
    least = least.withColumn("component", F.coalesce("component", "id"))
    names = least.groupBy("component").agg(F.min("least").alias("component_id"))
    other = (F.col("n") > 1) | ~F.col("component_id").eqNullSafe(F.col("least"))
    named = stage(least.join(names, "component").where(other).select("id", "component_id"), "names")
    # Only sets with another name than their one document travel; copies of one set may hold a third of the rows.
    joined = salted_join(rows, named, ["id"], ["doc_id"], SALTS, how="left", fits=fits_broadcast(named, BROADCAST_ROWS))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: the one with the smallest doc_id, and of rows that
    share it the one with the least text hash. Rows without any word stay."""
    rows, _, found = linked_components(docs, size, percent)
    at, hashed = free_name(docs, "_id"), free_name(docs, "_hash")
    named = [F.col("doc_id").alias(at), F.col("text_hash").alias(hashed)]
    known = rows.where("id is not null").join(stage(found, "components"), "id", "left")
    known = stage(known.select(*named, F.coalesce("component", "id").alias("component")).distinct(), "classed")
    key = F.struct(F.coalesce(F.col(at).cast("long"), F.lit((1 << 63) - 1)), hashed)
    best = known.groupBy("component").agg(F.min_by(F.struct(at, hashed), key).alias("kept"), F.count("*").alias("n"))
    best = stage(best.where("n > 1").select("component", "kept"), "kept-documents")
    others = salted_join(known, best, ["component"], [at, hashed], SALTS, fits=fits_broadcast(best, BROADCAST_ROWS))
    same = F.col(at).eqNullSafe(F.col("kept")[at]) & (F.col(hashed) == F.col("kept")[hashed])
    # Texts meet only the list of what goes, and that of rows which occur twice; both are short beside the corpus.
    gone = stage(others.where(~same).select(at, hashed), "dropped-documents")
    twice = rows.where("id is not null").groupBy(*named).agg(F.count("*").alias("n")).where("n > 1")
    twice = stage(twice.select(at, hashed), "repeated-rows")
    match = docs["doc_id"].eqNullSafe(F.col(at)) & (F.xxhash64(docs["text"]) == F.col(hashed))
    small = lambda x: F.broadcast(x) if fits_broadcast(x, BROADCAST_ROWS) else x
    left = docs.join(small(gone), match, "left_anti")
    once = left.join(small(twice), match, "left_anti")
    return once.unionByName(left.join(small(twice), match, "left_semi").dropDuplicates(["doc_id", "text"]))


def op9_ngram_jaccard_join(spark, sf_dir):
    return components_of(table(spark, sf_dir, "documents"))
