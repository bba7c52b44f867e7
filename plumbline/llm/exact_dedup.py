"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing the texts.

Contract. Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts
the row with the largest doc_id stays. One row comes back for each row of the input.

Cases: ids are whole numbers, what can't be read as one raises an error; rows that repeat an id are rows of their own in group_size, and those of equal text stay together (they are the same
document); a null id never wins over another, and stays where all its equals have none; null and empty texts are one
group; an empty table gives an empty result; only the id and the text are read, so other columns can't clash.

Fingerprint. The bytes are the coefficients of a polynomial, evaluated modulo a prime of 31 bits at four points. The values of
two pieces give that of their concatenation: head * point^(length of the tail) + tail. So a text is hashed as blocks, one
matrix product for all of them, and a text of more than HUGE bytes as pieces that are dealt to many tasks and joined by
the same rule.

Comparison. Rows of equal length and fingerprint are compared byte by byte, in chunks of CHUNK bytes: the chunks at one place
of a group are dealt to parts of about PART rows; a task streams through sorted parts with one chunk in its hand, passes on
rows that differ from it and, where a group has several parts, that chunk. The parts' chunks meet in the same way until
one is left, so neither a group of a third of all rows nor a huge text is ever in one task. What differs (a
collision of fingerprints) is told apart by its SHA-256.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _base as B

PRIME = (1 << 31) - 1
POINTS = (1_103_515_245, 1_664_525_013, 742_938_285, 950_706_376)
BLOCK = 8192  # 255 * 2^31 * BLOCK < 2^53: sums in doubles are exact
HUGE, CHUNK, PART = 16 << 20, 1 << 16, 256
#: distinct repeated texts (about 100 bytes each) that may be broadcast
CLASSES = 250_000
KEY = ["size", "f1", "f2"]
PRINT = "doc_id long, size long, f1 long, f2 long, sha binary"
PIECE = "sha binary, size long, k long, piece binary"
ROW = "size long, f1 long, f2 long, k long, part long, parts long, sha binary, chunk binary, odd boolean"


@functools.lru_cache(4)
def _powers(points: tuple[int, ...]) -> np.ndarray:
    """Row i: point^(BLOCK - 1 - i) for each point."""
    out = np.ones((BLOCK, len(points)))
    for i in range(BLOCK - 2, -1, -1):
        out[i] = [int(x) * p % PRIME for x, p in zip(out[i + 1], points)]
    return out


def shift(points: tuple[int, ...], length: int) -> list[int]:
    """What a head is multiplied by before a tail of so many bytes is added."""
    return [pow(p, length, PRIME) for p in points]


def combine(head: list[int], tail: list[int], by: list[int]) -> list[int]:
    """The fingerprint of a concatenation."""
    return [(h * s + t) % PRIME for h, t, s in zip(head, tail, by)]


def fingerprint(b: np.ndarray, points: tuple[int, ...] = POINTS) -> list[int]:
    """The value at each point of the polynomial whose coefficients are the bytes."""
    powers, first = _powers(points), len(b) % BLOCK
    out = [int(x) % PRIME for x in b[:first].astype(np.float64) @ powers[BLOCK - first :]]
    by = shift(points, BLOCK)
    for lo in range(first, len(b), 256 * BLOCK):
        blocks = b[lo : lo + 256 * BLOCK].reshape(-1, BLOCK).astype(np.float64)
        for tail in (blocks @ powers).astype(np.int64):
            out = combine(out, tail.tolist(), by)
    return out


def _packed(values: list[int]) -> tuple[int, int]:
    return values[0] << 31 | values[1], values[2] << 31 | values[3]


def _low(col: pa.Array):
    """(first row, rows, lower-cased bytes, offsets) for blocks of rows."""
    b, offs = B.text_buffers(col)
    for lo, hi in B.row_blocks(offs, 4 * B.PIECE):
        yield lo, hi - lo, B.lower_table()[b[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]


def _prints(points: tuple[int, ...], huge: int):
    """A row's length, fingerprint and SHA-256; of huge texts no fingerprint."""

    def run(batches):
        for batch in batches:
            for lo, n, b, offs in _low(batch.column(1)):
                texts = [b[offs[i] : offs[i + 1]] for i in range(n)]
                pairs = [(None, None) if len(x) > huge else _packed(fingerprint(x, points)) for x in texts]
                shas = [hashlib.sha256(x).digest() for x in texts]
                cols = [pa.array(np.diff(offs)), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array(shas, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), *cols], ["doc_id", "size", "f1", "f2", "sha"])

    return run


def _pieces(size: int):
    """Huge texts cut in pieces."""

    def run(batches):
        for batch in batches:
            for _, n, b, offs in _low(batch.column(0)):
                for i in range(n):
                    x = b[offs[i] : offs[i + 1]]
                    sha = hashlib.sha256(x).digest()
                    for k, at in enumerate(range(0, len(x), size)):
                        piece = x[at : at + size].tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([sha], pa.binary()), pa.array([len(x)]), pa.array([k]), pa.array([piece], pa.binary())], ["sha", "size", "k", "piece"])

    return run


def _hashed(points: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            pieces = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(3)]
            found = [fingerprint(x, points) for x in pieces]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, [shift(points, len(x)) for x in pieces])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["sha", "size", "k", "h", "s"])

    return run


def huge_prints(docs: DataFrame, text_col: str = "text", points: tuple[int, ...] = POINTS, huge: int = HUGE) -> DataFrame:
    """(sha, size, f1, f2) of the texts of more than `huge` bytes: pieces hashed by any tasks, joined in order."""
    long = docs.where(F.octet_length(text_col) > huge).select(text_col)
    pieces = long.mapInArrow(B.lean(_pieces(max(1, huge // 4))), PIECE).repartition("sha", "k")
    pieces = pieces.mapInArrow(B.lean(_hashed(points)), "sha binary, size long, k long, h array<long>, s array<long>")
    once = pieces.groupBy("sha", "size", "k").agg(F.first("h").alias("h"), F.first("s").alias("s"))
    row = once.groupBy("sha", "size").agg(F.array_sort(F.collect_list(F.struct("k", "h", "s"))).alias("all"))
    start = F.array(*[F.lit(0).cast("long")] * len(points))
    value = F.aggregate("all", start, lambda a, x: F.transform(a, lambda v, i: (v * F.get(x["s"], i) + F.get(x["h"], i)) % PRIME))
    v = [F.get("v", F.lit(i)) for i in range(4)]
    return row.select("sha", "size", value.alias("v")).select("sha", "size", (F.shiftleft(v[0], 31) + v[1]).alias("f1"), (F.shiftleft(v[2], 31) + v[3]).alias("f2"))


def _texts(batches):
    """(sha, lower-cased bytes) of each text."""
    for batch in batches:
        for _, n, b, offs in _low(batch.column(0)):
            shas = [hashlib.sha256(b[offs[i] : offs[i + 1]]).digest() for i in range(n)]
            low = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(b)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), low], ["sha", "low"])


def _compare(batches):
    """Over sorted chunks: those that differ from their part's first, and that one where a group has several parts."""
    names = [f.split()[0] for f in ROW.split(", ")]
    schema = pa.schema([(n, pa.binary() if n in ("sha", "chunk") else pa.bool_() if n == "odd" else pa.int64()) for n in names])
    held, first = None, None
    for batch in batches:
        out = []
        keys = zip(*[batch.column(i).to_pylist() for i in range(6)])
        for i, key in enumerate(keys):
            chunk = batch.column(7)[i].as_buffer()
            if key != held:
                held, first = key, chunk
                if key[5] > 1:
                    out.append((*key, batch.column(6)[i].as_py(), chunk.to_pybytes(), False))
            elif not first.equals(chunk):
                out.append((*key, batch.column(6)[i].as_py(), None, True))
        first = pa.py_buffer(first.to_pybytes()) if first is not None else None  # lets the batch go
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], names)


def _collisions(docs: DataFrame, text_col: str, shared: DataFrame, part: int, chunk: int, classes: int) -> DataFrame:
    """(size, f1, f2, sha) of the texts that differ from the one their fingerprint's group begins with."""
    most = shared.agg(F.max("of")).first()[0] or 0
    shared = shared.where("size > 0").withColumn("parts", F.ceil(F.col("of") / part)).select("sha", *KEY, "parts")
    rows = docs.select(text_col).where(F.col(text_col) != "").mapInArrow(B.lean(_texts), "sha binary, low binary")
    rows = rows.join(B.bounded_broadcast(shared, shared.count(), classes), "sha")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")))
    cuts = F.transform(F.expr(f"sequence(0L, (size - 1) div {chunk})"), lambda k: F.struct(k.alias("k"), F.substring("low", (k * chunk + 1).cast("int"), F.lit(chunk)).alias("chunk")))
    rows = rows.select(*KEY, "sha", "part", "parts", F.explode(cuts).alias("c")).select(*KEY, "c.k", "part", "parts", "sha", "c.chunk", F.lit(False).alias("odd"))
    parts, odd = -(-most // part), None
    while True:
        place = [*KEY, "k", "part"]
        met = B.store(rows.repartition(*place).sortWithinPartitions(*place, "sha").mapInArrow(B.lean(_compare), ROW), "compared")
        found = met.where("odd").select(*KEY, "sha")
        odd = found if odd is None else odd.union(found)
        if parts <= 1:
            return odd.distinct()
        rows = met.where("not odd").withColumns({"part": F.expr(f"part div {part}"), "parts": F.ceil(F.col("parts") / part)})
        parts = -(-parts // part)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", points: tuple[int, ...] = POINTS, huge: int = HUGE, part: int = PART, chunk: int = CHUNK, classes: int = CLASSES) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of docs.

    points: where the polynomial is evaluated; huge: bytes from which a text is hashed in pieces; part, chunk: rows and bytes
    of the comparison; classes: distinct repeated texts that may be broadcast, more are joined by a shuffle.
    """
    spark = B.session(docs)
    B.ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = B.store(src.mapInArrow(B.lean(_prints(points, huge)), PRINT), "prints")
    if not prints.where("f1 is null").isEmpty():
        long = B.store(huge_prints(src, "text", points, huge), "huge")
        filled = prints.where("f1 is null").drop("f1", "f2").join(long, ["sha", "size"]).select(*prints.columns)
        prints = B.store(prints.where("f1 is not null").union(filled), "prints")
    texts = B.store(prints.groupBy(*KEY, "sha").agg(F.max("doc_id").alias("last"), F.count("*").alias("n")), "texts")
    several = texts.groupBy(*KEY).agg(F.sum("n").alias("of")).where("of > 1")
    shared = B.store(texts.join(several, KEY), "shared")
    odd = B.store(_collisions(src, "text", shared, part, chunk, classes), "odd").withColumn("own", F.col("sha"))
    shared = shared.join(odd, [*KEY, "sha"], "left").withColumn("own", F.coalesce("own", F.unhex(F.lit(""))))
    groups = shared.groupBy(*KEY, "own").agg(F.max("last").alias("keep_id"), F.sum("n").alias("group_size"))
    equal = B.store(shared.join(groups, [*KEY, "own"]).where("group_size > 1").select("sha", *KEY, "keep_id", "group_size", F.lit(True).alias("met")), "equal")
    out = prints.join(B.bounded_broadcast(equal, equal.count(), classes), ["sha", *KEY], "left")
    keep: Column = F.when(F.col("met"), F.col("keep_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == keep, keep.isNull())
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY low)
SELECT d.doc_id, g.keep_id, g.n::BIGINT AS group_size, coalesce(d.doc_id = g.keep_id, g.keep_id IS NULL) AS kept, sha256(d.low) AS text_sha256
FROM d JOIN g ON d.low = g.low
"""
