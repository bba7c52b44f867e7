"""LM scoring by context-tree weighting over bytes.

Contract. A-Z are lower-cased; a text is its words (runs between ASCII white space) joined by one
space, then one end sign. Each byte is eight binary decisions; a node of a decision's context
tree is a depth (0 to DEPTH preceding bytes) and the bits so far, with a Krichevsky-Trofimov
estimate from its training counts. Block probabilities are weighted bottom-up, half for the
node and half for its children, which gives each node its posterior weight; a byte's
probability mixes the estimates along its path by these weights. A text starts from a context of end signs.
base_score is the add-half unigram score of the tokens (words and one end).

Cases: null, empty and blank texts are one end token; bytes never seen get the root's estimate;
with nothing to learn from every bit has probability one half; repeated rows score alike; an
empty table gives an empty result. Only the named columns are read, so others can't clash.

Scale. All training documents are counted: tasks send (word, n) rows, summed by Spark, and their grams of each
bucket as packed lists, which a task for each bucket merges. The tree holds every gram, whatever their number: what lies below depth SPLIT is cut by the
hash of the nearest SPLIT bytes into buckets, one for each SHARE bytes of text, each a task's own subtree; above
it are at most 256 ** SPLIT grams, broadcast. Probabilities of the grams with at least a power of
two of occurrences, the least that leaves at most MAX_GRAMS, are broadcast too; all others of a text go to
their subtrees, in parts of about ASKED, and come back as one sum for each row. Words are split alike: at most
MAX_WORDS frequent ones are broadcast with their counts, the counts of all others are joined. The
broadcasts are thus of bounded size at any input and what they leave out is joined exactly.
"""

from __future__ import annotations

import dataclasses
import functools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _base as B

DEPTH, END, SPACE, SPLIT = 6, 10, 32, 2
SHARE, ASKED = 1 << 22, 1 << 20  # bytes of text for each subtree, and codes that a subtree is asked at once
BUCKET, ROW, SUMMED = 1 << 15, 1 << 20, 1 << 15  # codes looked up at once, grams in a stored row, rows summed by a task
MAX_GRAMS, MAX_WORDS, FLUSH = 1 << 20, 1 << 20, 1 << 20
READ = 256  # rows that the Parquet reader takes at once
END_WORD = np.uint64(0x6A09E667F3BCC909)


# --- streams ------------------------------------------------------------------------------


@np.errstate(over="ignore")
def stream(b: np.ndarray, offs: np.ndarray, depth: int = DEPTH):
    """Gram codes of the rows' bytes (symbol in the low byte, then the nearest context first), their
    row offsets, word hashes, and the words' row offsets."""
    h, s, e, at = B.word_spans(b, offs)
    rows, lens = np.diff(at), e - s + 1
    n_bytes = np.concatenate([[0], np.cumsum(lens)])
    own = n_bytes[at[1:]] - n_bytes[at[:-1]]
    own[rows == 0] = 1  # the end alone
    ends = np.cumsum(own + depth)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint8)
    starts = ends - own
    row_of = np.repeat(np.arange(len(rows)), rows)
    to = starts[row_of] + n_bytes[:-1] - n_bytes[at[:-1]][row_of]
    step = np.arange(n_bytes[-1]) - np.repeat(n_bytes[:-1], lens)
    src, dst = np.repeat(s, lens) + step, np.repeat(to, lens) + step
    if len(src):
        np.minimum(src, len(b) - 1, out=src)
        out[dst] = B.lower_table()[b[src]]
        out[to + lens - 1] = SPACE
        out[ends[rows > 0] - 1] = END
    x = out.astype(np.uint64)
    code = x.copy()
    for k in range(1, depth + 1):
        code[k:] |= x[:-k] << np.uint64(8 * k)
    real = np.ones(len(out), bool)
    for k in range(depth):
        real[starts - 1 - k] = False
    return code[real], np.concatenate([[0], np.cumsum(own)]), h, at


def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The subtree of each code: by its nearest SPLIT context bytes."""
    return (B.mix((codes >> np.uint64(8)) & _mask(8 * SPLIT)) % np.uint64(buckets)).astype(np.int64)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: what is the same in all compresses to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(col: pa.ChunkedArray, kind) -> list[np.ndarray]:
    size = np.dtype(kind).itemsize
    return [np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(size, -1).T).view(kind).ravel() for x in col]


def _steps(x: np.ndarray) -> bytes:
    """Ascending numbers as their steps."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _climbed(col: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.cumsum(x, dtype=kind) for x in _numbers(col, kind)]


def _by_bucket(codes: np.ndarray, buckets: int):
    """(bucket, places) of the codes of each bucket that has some, in the order that they came in."""
    of = _bucket(codes, buckets)
    of = of.astype(np.int16) if buckets < 1 << 15 else of  # sorted by radix
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order], prepend=-1)) if len(of) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, [*cuts[1:], len(of)]):
        yield int(of[order[lo]]), order[lo:hi]


GRAMS = "bucket long, keys binary, counts binary"


def _count(depth: int, buckets: int):
    """Words (bucket null: key, n) and grams (a bucket's keys and counts, packed) of all batches."""
    def run(batches):
        held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
        kept = {0: 0, 1: 0}

        def rows(kind):
            k, c = _summed(*held[kind])
            held[kind] = ([], [])
            kept[kind] = 0
            if kind:
                none = pa.nulls(len(k), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c), pa.nulls(len(k), pa.int64()), none, none], names)
                return
            parts = [(b, _steps(k[at]), _planes(c[at].astype(np.int64))) for b, at in _by_bucket(k, buckets)]
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([x[0] for x in parts], pa.int64()), pa.array([x[1] for x in parts], pa.binary()), pa.array([x[2] for x in parts], pa.binary())], names)

        names = ["key", "n", "bucket", "keys", "counts"]
        for batch in batches:
            b, offs = B.text_buffers(batch.column(0))
            for lo, hi in B.row_blocks(offs, B.PIECE // 4):
                code, _, h, at = stream(b[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], depth)
                for kind, values in ((0, code), (1, h)):
                    k, c = np.unique(values, return_counts=True)
                    if kind:
                        k, c = np.append(k, END_WORD), np.append(c, hi - lo)
                    held[kind][0].append(k)
                    held[kind][1].append(c)
                    kept[kind] += len(k)
                    if kept[kind] > FLUSH:
                        k, c = _summed(*held[kind])
                        held[kind], kept[kind] = ([k], [c]), len(k)
                        if len(k) > FLUSH // 2:
                            yield from rows(kind)
        for kind in (0, 1):
            if kept[kind]:
                yield from rows(kind)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The grams of a bucket as one list, in rows of at most ROW grams."""
    k, c = _summed(_climbed(table.column("keys"), np.uint64), _numbers(table.column("counts"), np.int64))
    cuts = range(0, len(k), ROW)
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(cuts), pa.int64()), "keys": pa.array([_steps(k[i : i + ROW]) for i in cuts], pa.binary()), "counts": pa.array([_planes(c[i : i + ROW]) for i in cuts], pa.binary())})


# --- the tree ------------------------------------------------------------------------------


@functools.lru_cache(2)
def _small(shift: float) -> np.ndarray:
    return _lgamma(np.arange(1 << 12) + shift)


def _lgamma_of(n: np.ndarray, shift: float) -> np.ndarray:
    """Log gamma of whole numbers n plus shift."""
    table = _small(shift)
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    big = n >= len(table)
    out[big] = _lgamma(n[big] + shift)
    return out


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives a block with these counts."""
    return _lgamma_of(n0, 0.5) + _lgamma_of(n1, 0.5) - _lgamma_of(n0 + n1, 1.0) - math.log(math.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x > 0 by shifting and Stirling's series."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        shift[low] -= np.log(x[low])
        x[low] += 1
    r = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x


class Tree:
    """Grams of the depths from `top` on in order, their running counts, and the posterior weight of each of a gram's eight nodes.

    below: block probabilities that the nodes of the last depth have from further ones, for each
    bit (node, log probability, zeros, ones); totals: the same of the first depth's nodes.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], top: int = 0, below: list | None = None):
        self.top = top
        self.grams = [g for g, _ in tables]
        self.cum = [np.concatenate([[0], np.cumsum(c)]) for _, c in tables]
        self.weight = [np.ones((len(g), 8), np.float32) for g in self.grams]
        below = below or [None] * 8
        for i in range(len(tables) - 1, -1, -1):
            g, cum = self.grams[i], self.cum[i]
            now: list = []
            for j in range(8):
                keys = g >> np.uint64(8 - j)
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(g) else np.zeros(0, np.int64)
                last = np.append(first[1:], len(g))
                one = ((keys[first] << np.uint64(1)) | np.uint64(1)) << np.uint64(7 - j)
                mid = np.clip(np.searchsorted(g, one), first, last)
                n0, n1 = (cum[mid] - cum[first]).astype(float), (cum[last] - cum[mid]).astype(float)
                own = _log_kt(n0, n1)
                if below[j] is None:
                    total = own
                    w = np.ones(len(first))
                else:
                    k, p, c0, c1 = below[j]
                    parent = np.searchsorted(keys[first], k & _mask(8 * (top + i) + j))
                    kids = np.bincount(parent, weights=p, minlength=len(first)).astype(float)
                    r0 = n0 - np.bincount(parent, weights=c0, minlength=len(first))
                    r1 = n1 - np.bincount(parent, weights=c1, minlength=len(first))
                    kids += np.where(r0 + r1 > 0, _log_kt(np.maximum(r0, 0), np.maximum(r1, 0)), 0.0)
                    total = np.logaddexp(own, kids) - math.log(2)
                    w = 1 / (1 + np.exp(np.clip(kids - own, -50, 50)))
                    w[np.bincount(parent, minlength=len(first)) == 0] = 1.0
                self.weight[i][first, j] = w
                now.append((keys[first], total, n0, n1))
            below = now
        self.totals = below

    def log10(self, codes: np.ndarray, *above: Tree) -> np.ndarray:
        """log10 probability of each code's symbol after its context; above: trees of the lesser depths.

        From the root down, each depth takes the distinct codes of that many bytes: sorted by their bytes from the nearest on, these
        are runs. Per bit, `given` is what the lesser depths add, `left` the weight that they leave, and p the probability if no
        further depth has seen the context; what one depth has not seen, no further one has. Each bit halves the range of a
        context's grams.
        """
        if not len(codes):
            return np.zeros(0)
        order = np.argsort(codes.byteswap())
        codes = codes[order]
        run, p = np.zeros(len(codes), np.int64), np.full((8, 1), 0.5)  # each code's run at the depth so far
        given, left, place = np.zeros((8, 1)), np.ones((8, 1)), np.zeros(1, np.int64)
        for tree, i in [(t, i) for t in (*above[::-1], self) for i in range(len(t.grams))]:
            g, cum, weight = tree.grams[i], tree.cum[i], tree.weight[i]
            own = codes & _mask(8 * (tree.top + i) + 8)
            new = np.concatenate([[True], own[1:] != own[:-1]])
            own, parent = own[new], run[new]
            run, p = np.cumsum(new) - 1, p[:, parent]
            context = own & ~_mask(8)
            lo, hi = np.searchsorted(g, context), np.searchsorted(g, context | _mask(8), side="right")
            met = np.flatnonzero(hi > lo)
            own, lo, first, last = own[met], lo[met], cum[lo[met]], cum[hi[met]]
            given, left = given[:, place[parent[met]]], left[:, place[parent[met]]]
            place = np.zeros(len(parent), np.int64)
            place[met] = np.arange(len(met))
            for j in range(8):
                on = ((own >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
                mid = np.searchsorted(g, (own & ~_mask(8 - j)) | np.uint64(1 << (7 - j)))
                cut = cum[mid]
                n = last - first
                est = (np.where(on, last - cut, cut - first) + 0.5) / (n + 1.0)
                p[j, met] = np.where(n > 0, given[j] + left[j] * est, p[j, met])
                w = weight[np.minimum(lo, len(g) - 1), j].astype(float)
                given[j] += left[j] * w * est
                left[j] *= 1 - w
                lo, first, last = np.where(on, mid, lo), np.where(on, cut, first), np.where(on, last, cut)
        out = np.empty(len(codes))
        out[order] = np.log10(p.prod(axis=0))[run]
        return out


def _listed_grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = _climbed(table.column("keys"), np.uint64), _numbers(table.column("counts"), np.int64)
    return (np.concatenate(keys), np.concatenate(n)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _subtree(keys: np.ndarray, n: np.ndarray, depth: int) -> Tree:
    """The tree of a bucket's grams from depth SPLIT on."""
    return Tree([_summed([keys & _mask(8 * d + 8)], [n]) for d in range(SPLIT, depth + 1)], SPLIT)


def _bucket_totals(depth: int):
    """Of a bucket, by kind: what the nodes of depth SPLIT - 1 have below (bit 0 to 7), how often their grams occur (8), and
    how many grams occur at least 2 ** node times (9)."""
    def run(table: pa.Table) -> pa.Table:
        keys, n = _listed_grams(table)
        out = []
        for j, (k, p, n0, n1) in enumerate(_subtree(keys, n, depth).totals):
            nodes, at = np.unique(k & _mask(8 * (SPLIT - 1) + j), return_inverse=True)
            out.append((np.full(len(nodes), j, np.int32), nodes.view(np.int64), *(np.bincount(at, weights=x) for x in (p, n0, n1))))
        near, c = _summed([keys & _mask(8 * SPLIT)], [n])
        out.append((np.full(len(near), 8, np.int32), near.view(np.int64), np.zeros(len(near)), c.astype(float), np.zeros(len(near))))
        often = np.array([(n >= (1 << k)).sum() for k in range(48)], float)
        out.append((np.full(48, 9, np.int32), np.arange(48), np.zeros(48), often, np.zeros(48)))
        return pa.table({c: np.concatenate(x) for c, x in zip(("bit", "node", "p", "n0", "n1"), zip(*out))})

    return run


def _log10(tree: Tree, keys: np.ndarray, top: Tree) -> np.ndarray:
    """tree.log10 in blocks of codes that share their nearest bytes."""
    out, order = np.empty(len(keys)), np.argsort(keys.byteswap())
    for lo in range(0, len(keys), BUCKET):
        at = order[lo : lo + BUCKET]
        out[at] = tree.log10(keys[at], top)
    return out


@dataclasses.dataclass
class Model:
    """grams: stored (bucket, keys, counts); top: the tree above SPLIT; known: probabilities of frequent grams; frequent: counts
    of frequent words; rare: those of the others, a table; tokens and distinct: totals of the tokens."""

    depth: int
    grams: DataFrame
    buckets: int
    top: Tree
    known: Lookup | None
    frequent: Lookup
    rare: DataFrame
    tokens: int
    distinct: int

    def frequent_grams(self, least: int) -> DataFrame:
        """(key, p): log10 probability of each gram that occurs at least so often."""
        top, depth = B.session(self.grams).sparkContext.broadcast(self.top), self.depth  # at most 256 ** SPLIT grams

        def run(table: pa.Table) -> pa.Table:
            keys, n = _listed_grams(table)
            asked = keys[n >= least]
            p = _log10(_subtree(keys, n, depth), asked, top.value) if len(asked) else np.zeros(0)
            return pa.table({"key": asked.view(np.int64), "p": p})

        return self.grams.groupBy("bucket").applyInArrow(B.lean_group(run), "key long, p double")

    def row_sums(self, codes: DataFrame, entries: int, rows: int) -> DataFrame:
        """(row, total): log10 probabilities of codes summed by row.

        codes: (bucket, rows, keys), packed; entries: how many codes; rows: how many rows. A subtree packs its sums for
        about SUMMED rows at a time, so that what it sends doesn't grow with rows x subtrees.
        """
        top, depth = B.session(codes).sparkContext.broadcast(self.top), self.depth
        parts, shares = -(-entries // (self.buckets * ASKED)) or 1, max(8, -(-rows // SUMMED))

        def run(grams: pa.Table, wanted: pa.Table) -> pa.Table:
            if not len(wanted):
                return pa.table({"share": pa.array([], pa.int64()), "rows": pa.array([], pa.binary()), "totals": pa.array([], pa.binary())})
            keys, at = np.unique(np.concatenate(_numbers(wanted.column("keys"), np.uint64)), return_inverse=True)
            p = _log10(_subtree(*_listed_grams(grams), depth), keys, top.value)
            rows, place = np.unique(np.concatenate(_climbed(wanted.column("rows"), np.int64)), return_inverse=True)
            totals = np.bincount(place, weights=p[at])
            of = rows % shares
            own = [np.flatnonzero(of == k) for k in np.unique(of)]
            return pa.table({"share": pa.array([of[x[0]] for x in own], pa.int64()), "rows": pa.array([_steps(rows[x]) for x in own], pa.binary()), "totals": pa.array([_planes(totals[x]) for x in own], pa.binary())})

        def trimmed(grams: pa.Table, wanted: pa.Table) -> pa.Table:
            try:
                return run(grams, wanted)
            finally:
                B.trim()

        def total(table: pa.Table) -> pa.Table:
            rows, at = np.unique(np.concatenate(_climbed(table.column("rows"), np.int64)), return_inverse=True)
            return pa.table({"row": rows, "total": np.bincount(at, weights=np.concatenate(_numbers(table.column("totals"), np.float64)))})

        asked = codes.select("bucket", F.pmod(F.xxhash64("keys"), F.lit(parts)).alias("part"), "rows", "keys")
        grams = self.grams.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        found = grams.groupBy("bucket", "part").cogroup(asked.groupBy("bucket", "part")).applyInArrow(trimmed, "share long, rows binary, totals binary")
        return found.groupBy("share").applyInArrow(B.lean_group(total), "row long, total double")


class Lookup:
    """A hash table from uint64 keys to numbers, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype), np.zeros(1 << bits, bool)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = ~self.used[at]
            cells, pick = np.unique(at[free], return_index=True)
            who = left[free][pick]
            self.keys[cells], self.values[cells], self.used[cells] = keys[who], values[who], True
            placed = np.zeros(len(keys), bool)
            placed[who] = True
            stay = ~placed[left]
            left, at = left[stay], (at[stay] + 1) & self.mask

    @np.errstate(over="ignore")
    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * B.MULT[6] ^ (keys >> np.uint64(31))) * B.MULT[7] >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether found."""
        at = self.slot(keys)
        same = self.keys[at] == keys
        found = same & self.used[at]
        values = self.values[at]
        left = np.flatnonzero(~found & self.used[at])
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            ok = (self.keys[at] == keys[left]) & self.used[at]
            values[left[ok]] = self.values[at[ok]]
            found[left[ok]] = True
            go = ~ok & self.used[at]
            left, at = left[go], at[go]
        return values, found


def _bounded(table: DataFrame, limit: int) -> tuple[int, DataFrame]:
    """The least power of two of n that leaves at most limit rows, and those rows."""
    sums = table.agg(*[F.count_if(F.col("n") >= (1 << k)).alias(f"k{k}") for k in range(48)]).first()
    least = next(1 << k for k in range(48) if sums[k] <= limit)
    return least, table.where(F.col("n") >= least)


def _short_reads(spark) -> None:
    """Packed rows are long: the Parquet reader takes fewer of them at once."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(name, str(min(READ, int(spark.conf.get(name)))))


def learn(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, max_grams: int = MAX_GRAMS, max_words: int = MAX_WORDS) -> Model:
    """The model of docs. depth: SPLIT to 7; max_grams and max_words bound what is broadcast, not what is learned."""
    B.ship(B.session(docs))
    _short_reads(B.session(docs))
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(min(max(1, size // SHARE), 256**SPLIT))
    counts, path = B.stored(texts.mapInArrow(B.lean(_count(depth, buckets)), "key long, n long, " + GRAMS), "counts", "zstd")
    words = B.store(counts.where("bucket is null").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, often = _bounded(words, max_words)
    got = often.toArrow()
    frequent = Lookup(got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy())
    rare = words.where(F.col("n") < least)

    grams = counts.where("bucket is not null").select("bucket", "keys", "counts")
    grams = B.store(grams.groupBy("bucket").applyInArrow(B.lean_group(_merge), GRAMS), "grams", "zstd")
    B.remove(B.session(docs), path)  # words and grams are stored on their own
    sums = grams.groupBy("bucket").applyInArrow(B.lean_group(_bucket_totals(depth)), "bit int, node long, p double, n0 double, n1 double")
    sums = sums.groupBy("bit", "node").agg(*[F.sum(c).alias(c) for c in ("p", "n0", "n1")]).toArrow()  # at most 256 ** SPLIT nodes a kind
    bit, node, *sums = (sums.column(c).to_numpy() for c in ("bit", "node", "p", "n0", "n1"))
    below = [(node[bit == j].view(np.uint64), *(x[bit == j] for x in sums)) for j in range(8)]
    near, n = node[bit == 8].view(np.uint64), sums[1][bit == 8].astype(np.int64)
    top = Tree([_summed([near & _mask(8 * d + 8)], [n]) for d in range(SPLIT)], 0, below)
    model = Model(depth, grams, buckets, top, None, frequent, rare, int(total), int(distinct))
    least = min((1 << int(k) for k, x in zip(node[bit == 9], sums[1][bit == 9]) if x <= max_grams), default=1)
    got = model.frequent_grams(least).toArrow()  # at most max_grams rows
    model.known = Lookup(got.column("key").to_numpy().view(np.uint64), got.column("p").to_numpy())
    return model


def _listed(values: np.ndarray, odd: np.ndarray, at: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Each row's distinct values among those at the places `odd`, and how often they occur; at: the rows' offsets."""
    row_of = np.searchsorted(at, odd, side="right") - 1
    order = np.lexsort((values[odd], row_of))
    r, v = row_of[order], values[odd][order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])) if len(r) else np.zeros(0, np.int64)
    cuts = pa.array(np.searchsorted(r[first], np.arange(len(at))).astype(np.int32))
    times = np.diff(np.append(first, len(r))).astype(np.int32)
    return pa.ListArray.from_arrays(cuts, pa.array(v[first].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    spark = B.session(docs)
    B.ship(spark)
    _short_reads(spark)
    depth = model.depth
    shared = spark.sparkContext.broadcast((model.known, model.frequent))  # at most max_grams and max_words entries
    below = math.log10(model.tokens + 0.5 * (model.distinct + 1))
    never = math.log10(0.5) - below
    src = docs.select(*keep, F.col(text_col).alias("__text"))
    extra = "__row long, __tokens long, __known long, __base double, __score double, __bytes long, __rare array<long>, __times array<int>, __bucket long, __rows binary, __keys binary"
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in src.schema.fields[:-1]], *T.StructType.fromDDL(extra).fields])
    arrow = to_arrow_schema(schema)
    buckets = model.buckets

    def run(batches):
        known, frequent = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            b, offs = B.text_buffers(batch.column(batch.num_columns - 1))
            for lo, hi in B.row_blocks(offs, B.PIECE // 2):
                n = hi - lo
                code, at, h, word_at = stream(b[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], depth)
                p, ok = known.get(code)
                p_sum = np.concatenate([[0.0], np.cumsum(np.where(ok, p, 0.0))])
                odd = np.flatnonzero(~ok)
                c, ok = frequent.get(h)
                base = np.where(ok, np.log10(c + 0.5) - below, never)
                end_c, end_ok = frequent.get(np.array([END_WORD]))
                end = math.log10((int(end_c[0]) if end_ok[0] else 0) + 0.5) - below
                base_sum, ok_sum = np.concatenate([[0.0], np.cumsum(base)]), np.concatenate([[0], np.cumsum(ok)])
                words, times = _listed(h, np.flatnonzero(~ok), word_at)
                cols = [batch.column(i).slice(lo, n) for i in range(batch.num_columns - 1)]
                cols += [pa.array(row + np.arange(n)), pa.array(np.diff(word_at) + 1), pa.array(np.diff(ok_sum[word_at]) + int(end_ok[0])), pa.array(np.diff(base_sum[word_at]) + end)]
                cols += [pa.array(np.diff(p_sum[at])), pa.array(np.diff(at)), words, times]
                cols += [pa.nulls(n, f.type) for f in list(arrow)[len(cols) :]]
                yield pa.RecordBatch.from_arrays(cols, schema.names)
                # the other grams, packed by subtree
                of, flat = row + np.searchsorted(at, odd, side="right") - 1, code[odd]
                parts = [(k, _steps(of[x]), _planes(flat[x])) for k, x in _by_bucket(flat, buckets)]
                row += n
                if parts:
                    cols = [pa.nulls(len(parts), f.type) for f in list(arrow)[:-3]]
                    cols += [pa.array([x[i] for x in parts], f.type) for i, f in enumerate(list(arrow)[-3:])]
                    yield pa.RecordBatch.from_arrays(cols, schema.names)

    stored = B.store(src.mapInArrow(B.lean(run), schema), "scored", "zstd")
    rows = stored.where("__bucket is null").drop("__bucket", "__rows", "__keys")

    def entries(keys: str, times: str) -> DataFrame:
        met = rows.select("__row", F.explode(F.arrays_zip(keys, times)).alias("x"))
        return met.select("__row", F.col(f"x.{keys}").alias("key"), F.col(f"x.{times}").alias("times"))

    words = entries("__rare", "__times").join(model.rare, "key")
    words = words.groupBy("__row").agg(F.sum("times").alias("__more"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - math.log10(0.5))).alias("__up"))
    codes = stored.where("__bucket is not null").select(*[F.col(f"__{c}").alias(c) for c in ("bucket", "rows", "keys")])
    n = codes.agg(F.coalesce(F.sum(F.octet_length("keys") / 8), F.lit(0))).first()[0]
    codes = model.row_sums(codes, int(n), rows.count()).select(F.col("row").alias("__row"), F.col("total").alias("__odd"))
    out = rows.drop("__rare", "__times").join(words, "__row", "left").join(codes, "__row", "left")
    total = F.col("__score") + F.coalesce("__odd", F.lit(0.0))
    return out.select(
        *keep, F.col("__tokens").alias("n_tokens"), (F.col("__known") + F.coalesce("__more", F.lit(0))).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("__base") + F.coalesce("__up", F.lit(0.0))).alias("base_score"), total.alias("score"), (-total / math.log10(2) / F.col("__bytes")).alias("bits_per_byte"),
    )


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds
