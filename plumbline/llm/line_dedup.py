"""Line dedup by probing a sharded minimal perfect hash.

Contract. A text is split at line feeds (null or empty: one empty line). A line's key is the
line without ASCII white space at both ends and with A-Z lower-cased. Keys of at least
min_chars code points that occur in at least min_docs documents lose all their lines.

Cases: a key in exactly min_docs documents goes; null text counts as one empty line and becomes an empty text; every row is a document
of its own, also where ids repeat; an empty table stays empty; added columns carry a prefix
that the caller chooses, so other columns can't clash; the text's other columns pass untouched.

Scale. Documents send (hash, 1) once for each distinct line, summed before the shuffle. Hashes
that reach min_docs are dealt to shards of bounded size; each becomes a minimal perfect hash
(levels of bit arrays with ranks) over compact arrays: 64-bit fingerprints and counts. Hashes
below min_docs need no slot: a probe that meets no fingerprint keeps its line. Lines never
take part in a join: tasks stream the shards from the shared folder and keep them only while
they fit in CACHE bytes; a larger index is streamed once for the lines of PASS bytes of text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _base as B

SPACE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 16
CACHE, PASS = 64 << 20, 256 << 20
GAMMA = 2.0
KEY_BYTES = 32  # of a key in a decoded shard, about
SHARD = "shard long, n long, sizes array<long>, bits binary, fps binary, counts binary, spill binary"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower touches A-Z only


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "replace")) >= least)


def _lines(value) -> list[bytes]:
    return (value or b"").split(b"\n")


def _binary(col: pa.Array) -> list:
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def _count_lines(min_chars: int):
    def run(batches):
        for batch in batches:
            col = batch.column(0)
            _, offs = B.text_buffers(col)
            for lo, hi in B.row_blocks(offs, 16 * B.PIECE):
                seen: dict[bytes, int] = {}
                for value in _binary(col.slice(lo, hi - lo)):
                    own = {xxhash.xxh3_128_digest(k) for k in map(line_key, _lines(value)) if long_enough(k, min_chars)}
                    for h in own:
                        seen[h] = seen.get(h, 0) + 1
                raw = np.frombuffer(b"".join(seen), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(raw[:, 0])), pa.array(np.ascontiguousarray(raw[:, 1])), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], ["hi", "lo", "n"])

    return run


# --- minimal perfect hash -------------------------------------------------------------------


@np.errstate(over="ignore")
def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (B.mix(keys ^ (np.uint64(level + 1) * B.MULT[4])) % np.uint64(size)).astype(np.int64)


def mph_build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, bits of all levels, and each key's index in 0..n-1. Keys: distinct uint64."""
    sizes, bits, index, left, base = [], [], np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    level = 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = _slot(keys[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        ok = alone[at]
        ranks = np.cumsum(alone) - 1
        index[left[ok]] = base + ranks[at[ok]]
        base += int(alone.sum())
        sizes.append(size)
        bits.append(alone)
        left = left[~ok]
        level += 1
    return sizes, (np.concatenate(bits) if bits else np.zeros(0, bool)), index


def mph_find(keys: np.ndarray, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Index of each key, -1 where every level refuses it."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = base + _slot(keys[left], level, size)
        hit = bits[at]
        out[left[hit]] = ranks[at[hit]]
        left = left[~hit]
        base += size
    return out


def _build_shard(table: pa.Table) -> pa.Table:
    hi = table.column("hi").to_numpy().view(np.uint64)
    lo = table.column("lo").to_numpy().view(np.uint64)
    n = table.column("n").to_numpy()
    keys = hi ^ B.mix(lo)
    _, first = np.unique(keys, return_index=True)  # 64-bit ties of 128-bit hashes: the rest go to spill slots
    rest = np.setdiff1d(np.arange(len(keys)), first)
    spill = np.stack([keys[rest], lo[rest], n[rest].astype(np.uint64)], axis=1)
    sizes, bits, index = mph_build(keys[first])
    fps, counts = np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64)
    fps[index], counts[index] = lo[first], n[first]
    return pa.table({"shard": [table.column("shard")[0].as_py()], "n": [len(first)], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()], "fps": [fps.tobytes()], "counts": [counts.tobytes()], "spill": [spill.tobytes()]}, schema=pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("fps", pa.binary()), ("counts", pa.binary()), ("spill", pa.binary())]))


def build_index(docs: DataFrame, text_col: str, min_docs: int, min_chars: int = 1) -> tuple[str, int]:
    """Write the shards; returns their path and number."""
    spark = B.session(docs)
    B.ship(spark)
    lines = docs.select(F.col(text_col)).mapInArrow(B.lean(_count_lines(min_chars)), "hi long, lo long, n long")
    often = B.store(lines.groupBy("hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs), "lines")
    shards = max(1, -(-often.count() // SHARD_KEYS))
    path = B.new_path(spark, "shards")
    often.withColumn("shard", F.pmod(F.col("hi"), F.lit(shards))).groupBy("shard").applyInArrow(_build_shard, SHARD).write.parquet(path)
    return path, shards


_CACHED: dict[str, list] = {}


def _shards(path: str, cache: int):
    """Decoded shards of the index, one at a time; kept in this process if they are small."""
    if path in _CACHED:
        yield from _CACHED[path]
        return
    import pyarrow.dataset as ds
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    kept, total = [], 0
    for batch in ds.dataset(at, filesystem=where, format="parquet").to_batches(batch_size=1):
        for row in batch.to_pylist():
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
            ranks = (np.cumsum(bits) - 1).astype(np.int32)
            found = row["shard"], row["sizes"], bits, ranks, np.frombuffer(row["fps"], np.uint64), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["spill"], np.uint64).reshape(-1, 3)
            total += bits.nbytes + ranks.nbytes + 16 * row["n"] + len(row["spill"])
            kept = [*kept, found] if total <= cache else []
            yield found
    if total <= cache:
        _CACHED.clear()
        _CACHED[path] = kept


def probe(digests: list[bytes], path: str, shards: int, cache: int = CACHE) -> np.ndarray:
    """Document count of each line hash, 0 where the index has none."""
    out = np.zeros(len(digests), np.int64)
    raw = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    of = np.mod(raw[:, 0], shards)
    order = np.argsort(of, kind="stable")
    hi, lo = raw[order, 0].view(np.uint64), raw[order, 1].view(np.uint64)
    keys, of = hi ^ B.mix(lo), of[order]
    for shard, sizes, bits, ranks, fps, counts, spill in _shards(path, cache):
        a, z = np.searchsorted(of, shard), np.searchsorted(of, shard, side="right")
        if a == z:
            continue
        at = mph_find(keys[a:z], sizes, bits, ranks)
        ok = (at >= 0) & (fps[at] == lo[a:z])
        out[order[a:z][ok]] = counts[at[ok]]
        for key, fp, count in spill:
            out[order[a:z][(keys[a:z] == key) & (lo[a:z] == fp)]] = count
    return out


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, prefix: str = "", cache: int = CACHE, span: int = PASS) -> DataFrame:
    """docs with text_col replaced by the kept lines, plus <prefix>n_lines and <prefix>n_dropped.

    cache: bytes of an index that a Python worker keeps; span: bytes of text for each pass over a larger one.
    """
    path, shards = build_index(docs, text_col, min_docs, min_chars)
    names = [f"{prefix}n_lines", f"{prefix}n_dropped"]
    schema = T.StructType([f if f.name != text_col else T.StructField(text_col, T.StringType()) for f in docs.schema.fields] + [T.StructField(n, T.LongType()) for n in names])
    k = docs.columns.index(text_col)
    at_once = span if shards * SHARD_KEYS * KEY_BYTES > cache else 0

    def keyed(part):
        split = [_lines(v) for v in _binary(part.column(k))]
        return split, [(i, j, key) for i, ls in enumerate(split) for j, key in enumerate(map(line_key, ls)) if long_enough(key, min_chars)]

    def emit(parts):
        digests = [[xxhash.xxh3_128_digest(x[2]) for x in keyed(part)[1]] for part in parts]
        flat = [d for own in digests for d in own]
        often, at = probe(flat, path, shards, cache) >= min_docs if flat else [], 0
        for part, own in zip(parts, digests):
            split, lines = keyed(part)
            drop: dict[int, set[int]] = {}
            for (i, j, _), bad in zip(lines, often[at : at + len(own)]):
                if bad:
                    drop.setdefault(i, set()).add(j)
            at += len(own)
            texts = [b"\n".join(ls if i not in drop else [x for j, x in enumerate(ls) if j not in drop[i]]) for i, ls in enumerate(split)]
            cols = [part.column(c) for c in range(part.num_columns)]
            cols[k] = pa.array(texts, pa.binary()).cast(pa.string())
            cols += [pa.array([len(ls) for ls in split], pa.int64()), pa.array([len(drop.get(i, ())) for i in range(len(split))], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            _, offs = B.text_buffers(batch.column(k))
            for lo, hi in B.row_blocks(offs, 16 * B.PIECE):
                held.append(batch.slice(lo, hi - lo))
                size += int(offs[hi] - offs[lo])
                if size >= at_once:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return docs.mapInArrow(B.lean(run), schema)
