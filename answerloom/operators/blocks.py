"""Top-k units for many queries by weighted terms, block by block: (q, t, weight) meets (uid, terms with weights).

Pairs of a query and a unit, or of their blocks, are never rows. Units are packed into blocks of up to ``UNITS``, queries into blocks of up to
``QUERIES``; a task multiplies one block with another and keeps the running top k of the queries it is at, so its memory is
that of a block and what it passes on are k rows per query. Up to ``HELD`` blocks of queries are broadcast and units stay where they
are; more are dealt into groups, and a task meets ``HELD`` blocks of queries with ``GROUP`` blocks of units.

Terms are hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from answerloom.functions.ranking import top_k
from answerloom.session import stage

UNITS = 512
QUERIES = 1024
# A block of units is closed at so many tokens, however few units have them.
TOKENS = 1 << 18
HELD = 32
GROUP = 64
# Cells beyond this share a task, one after the other.
MAX_TASKS = 4096
BROADCAST_BYTES = 64 << 20
# Terms that more queries of a block than this ask for are multiplied as a matrix, at most so many.
SHARED = 8
DENSE_TERMS = 1024
OPEN = ["open_blocks", "open_at"]


def topk(weights: DataFrame, units: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(q, uid, score, rank) from (q, t, weight) and (uid, ts, ws, avgdl), ties by uid; units without a common term are left out.

    ``ts`` are hashes of terms. With null ``ws`` they are the tokens of the unit and weigh as BM25 has it, else ``ws`` are
    their weights and each is there once. A ``uid`` is there once.
    """
    return best(query_blocks(weights), unit_blocks(units, k1, b), k)


def best(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(q, uid, score, rank) from ``query_blocks`` and ``unit_blocks``.

    With columns ``open_blocks`` and ``open_at`` (numbers of blocks of queries and places of queries in them) a block of units
    is only scored for the queries that they name.
    """
    kinds = [dict(df.dtypes)[f"{x}_ids"][len("array<"):-1] for df, x in ((asked, "q"), (held, "u"))]
    schema = f"q {kinds[0]}, uid {kinds[1]}, score double"
    uid_type = to_arrow_type(held.schema["u_ids"].dataType.elementType)
    chosen = set(OPEN) <= set(held.columns)
    size = asked.agg(F.sum(F.octet_length("q_terms") * 3).alias("bytes"), F.count("*").alias("n")).first()
    asked = asked.select("q_block", "q_ids", "q_at", "q_terms", "q_weights")
    held_columns = ["u_ids", "u_at", "u_terms", "u_weights", *(OPEN if chosen else [])]
    if size["n"] <= HELD and (size["bytes"] or 0) <= BROADCAST_BYTES:
        shared = asked.sparkSession.sparkContext.broadcast(asked.toArrow())

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_work = None
            for batch in batches:
                if at_work is None:
                    every = shared.value
                    at_work = [(every["q_block"][r].as_py(), _Asked(every, r, k, uid_type)) for r in range(every.num_rows)]
                for r in range(batch.num_rows):
                    for block, x in at_work:
                        wanted = _open(batch, r, block) if chosen else None
                        if wanted is None or len(wanted):
                            x.meet(batch, r, wanted)
            yield from (x.best() for _, x in at_work or [])

        found = held.select(held_columns).mapInArrow(search, schema)
    else:
        held = stage(held, "unit-blocks")
        q_groups, u_groups = -(-size["n"] // HELD), max(1, -(-held.count() // GROUP))
        group = lambda block, n: F.pmod(F.xxhash64(block), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        keys = ["q_group", "u_group"]
        # A cell begins with its blocks of queries, which a task keeps; its units pass.
        asked = asked.select(group("q_block", q_groups).alias("q_group"), every(u_groups).alias("u_group"), F.lit(0).alias("side"), "*")
        held = held.select(
            every(q_groups).alias("q_group"), group("u_block", u_groups).alias("u_group"), F.lit(1).alias("side"), *held_columns
        )
        both = asked.unionByName(held, allowMissingColumns=True)
        both = both.repartition(min(q_groups * u_groups, MAX_TASKS), *keys).sortWithinPartitions(*keys, "side")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, at_work = None, []
            for batch in batches:
                at = list(zip(*(batch[c].to_pylist() for c in [*keys, "side", "q_block"])))
                for r, (*here, side, block) in enumerate(at):
                    if here != cell:
                        yield from (x.best() for _, x in at_work)
                        cell, at_work = here, []
                    if not side:
                        at_work.append((block, _Asked(batch, r, k, uid_type)))
                        continue
                    for number, x in at_work:
                        wanted = _open(batch, r, number) if chosen else None
                        if wanted is None or len(wanted):
                            x.meet(batch, r, wanted)
            yield from (x.best() for _, x in at_work)

        found = both.mapInArrow(search, schema)
    return top_k(found, ["q"], [F.desc("score"), F.asc("uid")], k)


def query_blocks(weights: DataFrame) -> DataFrame:
    """(q_ids, q_at, q_terms, q_weights, q_block) from (q, t, weight): whose the weights are by place in ``q_ids``."""
    kind = dict(weights.dtypes)["q"]
    rows = stage(
        weights.groupBy("q").agg(F.collect_list(F.struct("t", "weight")).alias("x")).select(
            "q", F.col("x.t").alias("ts"), F.col("x.weight").alias("ws")
        ),
        "asked",
    )
    parts = max(1, -(-rows.count() // QUERIES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, QUERIES):
                yield _block("q", batch.slice(i, QUERIES), batch.column(2).slice(i, QUERIES).flatten().to_numpy(zero_copy_only=False))

    made = rows.repartition(parts).mapInArrow(pack, _schema("q", kind)).withColumn("q_block", F.monotonically_increasing_id())
    return stage(made, "query-blocks")


def unit_blocks(units: DataFrame, k1: float, b: float, per_block: int = UNITS) -> DataFrame:
    """(u_ids, u_at, u_terms, u_weights, u_block) from (uid, ts, ws, avgdl), of units as they lie; nothing is shuffled."""
    kind = dict(units.dtypes)["uid"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(_sizes(batch.column(1)))
            i = 0
            while i < batch.num_rows:
                before = ends[i - 1] if i else 0
                end = max(i + 1, min(i + per_block, int(np.searchsorted(ends, before + TOKENS, side="right"))))
                yield from _weighted(batch.slice(i, end - i), k1, b)
                i = end

    rows = units.select("uid", "ts", "ws", "avgdl")
    return rows.mapInArrow(pack, _schema("u", kind)).withColumn("u_block", F.monotonically_increasing_id())


def _weighted(part: pa.RecordBatch, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Blocks of the units that come as tokens, and of those that come with weights."""
    given = part.column(2).is_valid()
    ready = part.filter(given)
    if ready.num_rows:
        yield _block("u", ready, ready.column(2).flatten().to_numpy(zero_copy_only=False))
    part = part.filter(pa.array(~given.to_numpy(zero_copy_only=False)))
    if not part.num_rows:
        return
    sizes, ts = _sizes(part.column(1)), part.column(1).flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.lexsort((ts, row))
    row, ts = row[order], ts[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (ts[1:] != ts[:-1])]) if len(ts) else np.zeros(0, int)
    tf = np.diff(np.r_[first, len(ts)]).astype(float)
    row, ts = row[first], ts[first]
    average = part.column(3).to_numpy(zero_copy_only=False)[row]
    yield _columns("u", part.column(0), row, ts, tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / average)))


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _block(x: str, part: pa.RecordBatch, weights: np.ndarray) -> pa.RecordBatch:
    sizes = _sizes(part.column(1))
    at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return _columns(x, part.column(0), at, part.column(1).flatten().to_numpy(zero_copy_only=False), weights)


def _schema(x: str, kind: str) -> str:
    return f"{x}_ids array<{kind}>, {x}_at binary, {x}_terms binary, {x}_weights binary"


def _columns(x: str, ids: pa.Array, at: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    named = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    data = [np.ascontiguousarray(v, kind).tobytes() for v, kind in ((at, np.int32), (terms, np.int64), (weights, np.float64))]
    return pa.record_batch(
        [named, *(pa.array([v], pa.binary()) for v in data)], names=[f"{x}_{c}" for c in ("ids", "at", "terms", "weights")]
    )


def _open(batch: pa.RecordBatch, r: int, block: int) -> np.ndarray:
    named, at = (batch[c][r].values.to_numpy(zero_copy_only=False) for c in OPEN)
    return at[named == block]


def _entries(batch: pa.RecordBatch, x: str, r: int) -> list[np.ndarray]:
    kinds = {"at": np.int32, "terms": np.int64, "weights": np.float64}
    return [np.frombuffer(batch[f"{x}_{c}"][r].as_buffer(), kind) for c, kind in kinds.items()]


class _Asked:
    """A block of queries and the best units that it has met."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, r: int, k: int, kind: pa.DataType):
        # A copy: a view would keep the whole batch.
        ids = batch["q_ids"][r].values
        self.ids, self.k, self.kind = ids.take(pa.array(np.arange(len(ids)))), k, kind
        at, terms, weights = _entries(batch, "q", r)
        n = len(self.ids)
        self.terms, of = np.unique(terms, return_inverse=True)
        asking = np.bincount(of, minlength=len(self.terms))
        shared = np.argsort(-asking, kind="stable")[:DENSE_TERMS]
        shared = shared[asking[shared] > SHARED]
        self.column = np.full(len(self.terms), -1)
        self.column[shared] = np.arange(len(shared))
        self.matrix = np.zeros((len(shared), n))
        dense = self.column[of] >= 0
        np.add.at(self.matrix, (self.column[of[dense]], at[dense]), weights[dense])
        order = np.argsort(of[~dense], kind="stable")
        self.listed, self.listed_weights = at[~dense][order], weights[~dense][order]
        self.size = np.where(self.column >= 0, 0, asking)
        self.start = np.cumsum(self.size) - self.size
        self.least = np.zeros(n)
        self.at, self.uid, self.score = np.zeros(0, int), np.zeros(0, object), np.zeros(0)

    def scores(self, batch: pa.RecordBatch, r: int, n_units: int) -> np.ndarray:
        row, terms, w = _entries(batch, "u", r)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        row, w, at = row[known], w[known], at[known]
        column = self.column[at]
        dense = column >= 0
        m = np.zeros((n_units, len(self.matrix)))
        m[row[dense], column[dense]] = w[dense]
        made = m @ self.matrix
        size = self.size[at]
        many = np.repeat(np.arange(len(at)), size)
        entry = self.start[at][many] + np.arange(len(many)) - np.repeat(np.cumsum(size) - size, size)
        np.add.at(made, (row[many], self.listed[entry]), w[many] * self.listed_weights[entry])
        return made

    def meet(self, batch: pa.RecordBatch, r: int, wanted: np.ndarray | None = None) -> None:
        uids = batch["u_ids"][r].values
        made = self.scores(batch, r, len(uids))
        # Rounding may lift a score by half a millionth.
        floor = self.least - 1e-6
        if not self.least.any() and len(uids) > self.k:
            floor = np.partition(made, -self.k, axis=0)[-self.k] - 1e-6
        good = (made > 0) & (made >= floor)
        if wanted is not None:
            named = np.zeros(len(self.ids), bool)
            named[wanted] = True
            good &= named
        row, at = np.nonzero(good)
        if not len(row):
            return
        score = np.floor(made[row, at] * 1e6 + 0.5) / 1e6
        uid = np.array(uids.to_pylist(), dtype=object)[row]
        at, uid, score = (np.concatenate(x) for x in ((self.at, at), (self.uid, uid), (self.score, score)))
        there = np.array([u is not None for u in uid])
        plain = uid.copy()
        plain[~there] = "" if pa.types.is_string(self.kind) else 0
        order = np.lexsort((plain, there, -score, at))
        at, uid, score = at[order], uid[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        last = place == self.k - 1
        self.least[at[last]] = score[last]
        kept = place < self.k
        self.at, self.uid, self.score = at[kept], uid[kept], score[kept]

    def best(self) -> pa.RecordBatch:
        columns = [self.ids.take(pa.array(self.at)), pa.array(self.uid.tolist(), self.kind), pa.array(self.score)]
        return pa.record_batch(columns, names=["q", "uid", "score"])
