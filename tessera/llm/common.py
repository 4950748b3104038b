"""Shared pieces of the training-data operators: scratch tables, byte-level text kernels, packed blocks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import scratch

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of an Arrow batch, beyond which it takes no further row.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of at most so many rows and about BATCH_BYTES from now on, as rows may hold long texts."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        number = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < number <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give freed memory back to the system, which allocators else keep while a worker lives, idle or not."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Task) -> Task:
    """The task, with what earlier tasks of its worker and it itself have freed given back before and after it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return tidied


def materialize(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back; narrow as for scratch.materialize."""
    return scratch.materialize(df, narrow)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Places in the versions of a repeated id with different texts are so far apart.
VERSION = 1 << 40


def with_versions(texts: DataFrame) -> tuple[DataFrame, bool]:
    """texts (id, text) with base, what is added to places in them, and whether any id has several rows.

    The base is 0 but where an id has different texts: these are numbered in the order of their hashes.
    """
    h = F.xxhash64("text")
    ids = texts.groupBy("id").agg(F.count("*").alias("n"), F.min(h).alias("lo"), F.max(h).alias("hi")).filter("n > 1")
    ids = materialize(ids.select("id", F.expr("lo <> hi").alias("differ")), narrow=True)
    none = F.lit(0).cast("long")
    if not ids.limit(1).count():
        return texts.withColumn("base", none), False
    if not ids.filter("differ").limit(1).count():
        return texts.withColumn("base", none), True
    versions = texts.select("id", h.alias("h")).join(ids.filter("differ").select("id"), "id").distinct()
    versions = materialize(versions.select("id", "h", ((F.row_number().over(Window.partitionBy("id").orderBy("h")) - 1) * F.lit(VERSION)).alias("base")), narrow=True)
    return texts.withColumn("h", h).join(versions, ["id", "h"], "left").select(*texts.columns, F.coalesce("base", none).alias("base")), True


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], salt: Column, total: int) -> DataFrame:
    """rows with what keys has for them; keys: one row a key with n, its number of rows.

    A key with a large share of the total is copied, and its rows are dealt out to the copies by the salt, so that no
    task gets them all. At most some partitions keys are so large.
    """
    bound = max(100, total // (2 * partitions(rows.sparkSession)))
    copies = F.ceil(F.col("n") / F.lit(bound)).cast("int")
    hot = F.broadcast(keys.filter(F.col("n") > bound).select(*on, copies.alias("_copies")))
    dealt = rows.join(hot, on, "left").withColumn("_salt", F.pmod(salt, F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    copied = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.join(copied, [*on, "_salt"]).drop("_salt")


# --- hashing ------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on whole arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C55
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    if len(_POWERS.get("p", ())) <= n:
        size = max(n + 1, 5 << 18)
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["i"]


def prefix_hashes(data: np.ndarray, table: np.ndarray = _BYTES) -> np.ndarray:
    """H with H[j] - H[i] the polynomial hash of data[i:j], scaled by base**i."""
    p, _ = powers(len(data))
    h = np.empty(len(data) + 1, dtype=U64)
    h[0] = 0
    np.cumsum(table[data] * p[: len(data)], out=h[1:])
    return h


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(h))
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(U64))


# --- texts as bytes -----------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets (n + 1); null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes and at most 60,000 rows; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n, i + 60_000)
        yield i, j
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than 0x20 and 0x09-0x0D; no word crosses rows."""
    return class_spans(~_SPACE[data], off)


def class_spans(word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of marked bytes; no run crosses rows."""
    first = np.zeros(len(word), dtype=bool)
    rows = off[:-1][np.diff(off) > 0]
    first[rows] = True
    before = np.empty(len(word), dtype=bool)
    if len(word):
        before[0] = False
        before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | first))
    last = np.ones(len(word), dtype=bool)
    if len(word):
        last[:-1] = ~word[1:] | first[1:]
    end = np.flatnonzero(word & last) + 1
    row = np.searchsorted(off, start, side="right") - 1
    return start, end, row


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z lower-cased, and its row."""
    start, end, row = word_spans(data, off)
    return span_hashes(prefix_hashes(_LOWER[data]), start, end), row


# --- packed blocks ------------------------------------------------------------------------------


def pack(columns: list[np.ndarray]) -> bytes:
    return b"".join([np.int64(len(columns[0])).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])


def unpack(blobs: Iterable[bytes], kinds: list) -> list[np.ndarray]:
    """The columns of several blocks, joined."""
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for b in blobs:
        n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
        for o, k in zip(out, kinds, strict=True):
            o.append(np.frombuffer(b, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(o) for o in out]


def deal(part: np.ndarray, n_parts: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """One block for each part that has rows."""
    part = part.astype(np.int64)
    order = np.argsort(part.astype(np.uint16), kind="stable")
    columns = [c[order] for c in columns]
    at = np.searchsorted(part[order], np.arange(n_parts + 1))
    for p in np.flatnonzero(np.diff(at)):
        yield int(p), pack([c[at[p] : at[p + 1]] for c in columns])


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal neighbours, and each row's run."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def spans_of(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(start, end) of each run."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n][: len(starts)], strict=True))


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [start, end), and each one's range."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n), which


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
