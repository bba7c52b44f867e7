"""Shared pieces: stored tables, code shipping, Arrow text access and vectorised word hashing.

Bounds: the numpy helpers work on pieces of about one megabyte, so memory per task
follows the longest document of an Arrow batch, not the partition.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
ZIP_NAME = "plumbline_llm_code.zip"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package once a context, wherever the driver found it."""
    # texts are long: fewer rows in an Arrow batch keep a task's memory small
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") or 0) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), ZIP_NAME)
    with zipfile.ZipFile(path, "w") as z:
        for root, _, names in os.walk(os.path.join(top, "plumbline")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    sc._plumbline_shipped = True


BATCH_ROWS = 1000


def trim() -> None:
    """Give freed memory back to the system."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(run):
    """run over Arrow batches, with freed memory given back to the system between and after tasks."""
    import functools as ft

    @ft.wraps(run)
    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def lean_group(run):
    """The same for a function of one group."""

    def wrapped(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return run(table)
        finally:
            trim()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master where none is configured."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_plumbline_dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = sc._plumbline_dir = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="plumbline-"))
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/plumbline-{what}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc._plumbline_paths = [*getattr(sc, "_plumbline_paths", []), path]
    return path


def clean(spark: SparkSession) -> int:
    """Delete what this session has stored in the shared folder, once its results are written; returns how many tables."""
    paths = list(getattr(spark.sparkContext, "_plumbline_paths", []))
    for p in paths:
        remove(spark, p)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing will read again."""
    sc = spark.sparkContext
    sc._plumbline_paths = [p for p in getattr(sc, "_plumbline_paths", []) if p != path]
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def store(df: DataFrame, what: str = "t", codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    return stored(df, what, codec)[0]


def stored(df: DataFrame, what: str = "t", codec: str = "snappy") -> tuple[DataFrame, str]:
    """store, with the path, for tables to be removed before the end."""
    spark = session(df)
    path = new_path(spark, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bounded_broadcast(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Hint a broadcast of narrow rows only when their counted number is within the limit."""
    return F.broadcast(df) if rows <= limit else df


# --- Arrow text -------------------------------------------------------------------------


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


# --- hashing ------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3], dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(PIECE, _BASE), _powers(PIECE, pow(_BASE, -1, 1 << 64))


@functools.lru_cache(1)
def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return t


@functools.lru_cache(1)
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def _cuts(b: np.ndarray, offs: np.ndarray) -> list[int]:
    """Piece borders: at most PIECE bytes apart, at white space or a row's start where one exists."""
    space, at, n, cuts = space_table(), 0, len(b), [0]
    while n - at > PIECE:
        row = offs[np.searchsorted(offs, at + PIECE, side="right") - 1]
        gap = np.flatnonzero(space[b[at : at + PIECE]])
        to = max(int(row), at + int(gap[-1]) + 1 if len(gap) else at)
        while to <= at:  # one word longer than a piece: look further
            far = np.flatnonzero(space[b[at + 1 : at + 64 * PIECE]])
            nxt = offs[np.searchsorted(offs, at, side="right") :][:1]
            ends = [at + 2 + int(far[0])] if len(far) else []
            ends += [int(nxt[0])] if len(nxt) else []
            to = min(ends or [n])
        cuts.append(to)
        at = to
    cuts.append(n)
    return cuts


@np.errstate(over="ignore")
def word_spans(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words between white space, their starts and ends, and each row's word offsets."""
    hashes, starts_all, ends_all = [], [], []
    cuts = _cuts(b, offs)
    space, low = space_table(), lower_table()
    for lo, hi in zip(cuts, cuts[1:]):
        if lo == hi:
            continue
        p = low[b[lo:hi]]
        w = ~space[p]
        breaks = offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi)] - lo
        prev = np.zeros(len(p), bool)
        prev[1:] = w[:-1]
        prev[breaks] = False
        nxt = np.zeros(len(p), bool)
        nxt[:-1] = w[1:]
        nxt[breaks[breaks > 0] - 1] = False
        s, e = np.flatnonzero(w & ~prev), np.flatnonzero(w & ~nxt) + 1
        pw, inv = _tables() if len(p) <= PIECE else (_powers(len(p), _BASE), _powers(len(p), pow(_BASE, -1, 1 << 64)))
        total = np.zeros(len(p) + 1, np.uint64)
        np.cumsum((p.astype(np.uint64) + np.uint64(1)) * pw[: len(p)], out=total[1:])
        h = (total[e] - total[s]) * inv[s]
        hashes.append(mix(h ^ ((e - s).astype(np.uint64) * MULT[0])))
        starts_all.append(s + lo)
        ends_all.append(e + lo)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offs), np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), starts, np.concatenate(ends_all), np.searchsorted(starts, offs)


def word_hashes(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_spans without the places."""
    h, _, _, at = word_spans(b, offs)
    return h, at


def row_blocks(offs: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or one row."""
    out, at, n = [], 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = max(at + 1, min(to, n))
        out.append((at, to))
        at = to
    return out


# --- components ---------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, comp), comp the smallest node reachable.

    Alternates the large-star and small-star steps until nothing changes; every round is
    stored, nothing but a count and a checksum comes to the driver.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def sign(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = least(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        e = store(small, "cc")
        now = sign(e)
        if now == before or not now[0]:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
