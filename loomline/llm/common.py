"""Helpers shared by the operators: written tables, text buffers, word hashes."""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import new_path

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def raw(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


#: While a table is written: shuffle files behind it go as soon as it is there, and workers get Arrow batches of a few
#: megabytes, since a worker, the executor and the buffers between them each hold one.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """The frame as a table in the shared folder, in a folder for each value of ``by``."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.partitionBy(*([by] if by else [])).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete written tables, or one folder of them, that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{t.written_to}/{part}" if part else t.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def lean_memory() -> None:
    """Let the C allocator of this process give large arrays back to the system as soon as they are freed, and keep few
    arenas. Otherwise workers that serve one stage after another hold the largest amount that any of them needed."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # another C library
        return
    for option, value in ((-3, 1 << 20), (-1, 1 << 20), (-8, 2)):  # mmap threshold, trim threshold, arenas
        mallopt(option, value)


def give_back() -> None:
    """Return to the system what this process has freed. Workers take tasks in turn and stay for a minute, so what each
    keeps of its last task adds up in an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# ---- vectors -----------------------------------------------------------


def dimension(vectors: DataFrame, vector: str = "embedding") -> int:
    """The most frequent length; 0 for a table without vectors."""
    top = (
        vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count()
        .orderBy(F.desc("count"), F.desc("d")).first()
    )
    return top["d"] if top else 0


def valid_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``(vec_id, v)`` as doubles, and the dimension.

    Rows without an id, and vectors that are null, of another length than
    most, or hold null or non-finite components take no part. An id names
    one row: of several rows with one id the smallest vector counts.
    """
    d = dimension(vectors, vector)
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (
        vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == d) & sound)
        .select(F.col(key).cast("long").alias("vec_id"), x.alias("v"))
    )
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")), d


# ---- texts -------------------------------------------------------------


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """A hash that spreads rows: by id, and by text where the id is null."""
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string"))).otherwise(F.xxhash64(text))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def n_blocks(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind one another, and where each begins and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


#: Texts of an Arrow batch that are taken at once.
SOME = 512


def some_texts(column: pa.Array, *more: pa.Array):
    """A column in slices of SOME texts, with the same slices of further columns, so that only these are copied."""
    for i in range(0, len(column), SOME):
        yield (column.slice(i, SOME), *(c.slice(i, SOME) for c in more))


def pieces(at: np.ndarray, size: int):
    """Ranges of documents of about ``size`` bytes; a longer document stands alone."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each document."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)


_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
_P = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 2**64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[:1], down[:1] = 1, 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, from prefix sums over chunks of about a million bytes."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _CHUNK, "right")))
        a, b = start[i], end[j - 1]
        up, down = _powers(_P, b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLE[buf[a:b]] * up[:-1], dtype=np.uint64, out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of every run of ``length`` words."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    base = (_P * (2 * seed + 3) * 8 + 5) % 2**64
    up, down = _powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(seed)) * up[:-1], dtype=np.uint64, out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[: n - length + 1])
