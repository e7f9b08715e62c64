"""What the operators share: batches of bounded size, words, hashes of shingles, and sampling."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 500
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches hold at most ``rows`` rows: a Python worker holds one batch of whole texts at a time."""
    if int(spark.conf.get(BATCH_CONF)) > rows:
        spark.conf.set(BATCH_CONF, str(rows))


_remembered: list[Callable[[], None]] = []


def remembers(empty: Callable[[], None]) -> None:
    """Register how to empty what a module keeps in a Python worker between tasks."""
    _remembered.append(empty)


def forget() -> None:
    """Workers serve one operator after another: empty what others have kept, and give free memory back."""
    for empty in _remembered:
        empty()
    pa.default_memory_pool().release_unused()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it unlike all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def words(text: bytes) -> list[bytes]:
    r"""``[^\x20\x09-\x0D]+``: what bytes.split() calls white space are just these six bytes."""
    return text.split()


def word_hashes(parts: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, parts)), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per window of ``size`` words, in order; the whole sequence where it is shorter; none without words."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(n, size)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = (total ^ hashes[k : n - width + 1 + k]) * M1
        total ^= total >> np.uint64(29)
    return mixed(total)


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def keep_share(key: Column, share: Column) -> Column:
    """Whether a row belongs to a sample of about ``share`` of the rows; the same rows each time."""
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 20)) < share * (1 << 20)


def ids_crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
