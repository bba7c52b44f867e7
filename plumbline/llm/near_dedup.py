"""MinHash near-duplicates: one-permutation hashing with optimal densification.

Contract. Words are the runs between ASCII white space after lower-casing A-Z; a text's set
is its distinct 5-word shingles (fewer words: the whole sequence is one shingle). Texts with
at least one word and intersection/union >= threshold are linked; a component's id is its
smallest doc_id.

Cases: ids are whole numbers, what can't be read as one raises an error; null, empty or blank text has an empty set and is linked with nothing (the row is its own
component); rows with words that repeat a doc_id, with equal or other texts, are one vertex: the links of all their
texts are its links and they get the same component; a null doc_id keeps its row, with a null component, and is
kept. Ties at the threshold are links. An empty table gives an empty result. Only the id and text columns are
read, so other columns can't clash.

Scale. One pass makes signatures. Equal sets collapse into one class before any bucket is
formed. Each bucket proposes star edges from a hub (the member that shares most buckets), so
edges are linear in members. Edges are confirmed on the full sets. Buckets whose members are then
all in one component are finished; the others are compared in pairs of blocks of about BLOCK
members, each block pair a task of its own that returns no more links than join its components,
so no pair that shares a bucket is left open and none is emitted as a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base as B

BINS, ROWS, SHINGLE, BLOCK = 64, 4, 5, 256
SIG = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


@np.errstate(over="ignore")
def shingle_sets(b: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    wh, wo = B.word_hashes(b, offs)
    n = len(wh)
    full = np.zeros(0, np.uint64)
    if n >= SHINGLE:
        full = wh[: n - SHINGLE + 1] * B.MULT[0]
        for j in range(1, SHINGLE):
            full = full + wh[j : n - SHINGLE + 1 + j] * B.MULT[j]
        full = B.mix(full)
    out = []
    for lo, hi in zip(wo, wo[1:]):
        if hi - lo >= SHINGLE:
            out.append(np.unique(full[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            few = (wh[lo:hi] * B.MULT[: hi - lo]).sum(dtype=np.uint64) + B.MULT[SHINGLE + 1] * np.uint64(hi - lo)
            out.append(B.mix(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@np.errstate(over="ignore")
def densified(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation minima of each set, empty bins filled from random other bins (same choice for all sets)."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(58)
    mins, empty = np.zeros((len(sets), BINS), np.uint64), np.ones((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            ends = np.append(at[1:], len(s))
            full = at < ends
            mins[i, full] = s[at[full]]
            empty[i] = ~full
    filled, r, c = mins.copy(), *np.nonzero(empty & np.array([len(s) > 0 for s in sets])[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        donor = (B.mix((c.astype(np.uint64) + np.uint64(1)) * B.MULT[1] + np.uint64(attempt) * B.MULT[2]) >> np.uint64(58)).astype(np.int64)
        ok = ~empty[r, donor]
        filled[r[ok], c[ok]] = mins[r[ok], donor[ok]]
        r, c = r[~ok], c[~ok]
    return filled


def _signatures(batches):
    for batch in batches:
        ids = batch.column(0)
        b, offs = B.text_buffers(batch.column(1))
        for lo, hi in B.row_blocks(offs, 4 * B.PIECE):
            sets = shingle_sets(b[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            m = densified(sets)
            bands = np.zeros((len(sets), BINS // ROWS), np.uint64)
            for j in range(ROWS):
                bands += m[:, j::ROWS] * B.MULT[j]
            bands = B.mix(bands + np.arange(BINS // ROWS, dtype=np.uint64) * B.MULT[5])
            h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            h2 = np.array([B.mix(s ^ B.MULT[3]).sum(dtype=np.uint64) for s in sets], np.uint64)
            n = np.array([len(s) for s in sets], np.int64)
            flat = pa.array(bands.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], ["doc_id", "n_shingles", "h1", "h2", "bands"])


def _confirm(percent: int):
    def run(batches):
        last, last_set = None, None
        for batch in batches:
            a_ids, b_ids, ta, tb = (batch.column(i) for i in range(4))
            keep = np.zeros(len(a_ids), bool)
            (ba, oa), (bb, ob) = B.text_buffers(ta), B.text_buffers(tb)
            for lo, hi in B.row_blocks(ob, 2 * B.PIECE):
                sets = shingle_sets(bb[ob[lo] : ob[hi]], ob[lo : hi + 1] - ob[lo])
                for i in range(lo, hi):
                    raw = ba[oa[i] : oa[i + 1]]
                    if last is None or len(raw) != len(last) or not np.array_equal(raw, last):
                        last, last_set = raw.copy(), shingle_sets(raw, np.array([0, len(raw)]))[0]
                    s = sets[i - lo]
                    both = len(np.intersect1d(last_set, s, assume_unique=True))
                    keep[i] = both > 0 and 100 * both >= percent * (len(last_set) + len(s) - both)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([a_ids.take(at), b_ids.take(at)], ["a", "b"])

    return run


def _compare(percent: int):
    """Links between the components of a block pair: enough of them to join what is linked."""

    def run(table: pa.Table) -> pa.Table:
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        b, offs = B.text_buffers(table.column("text"))
        sets = [x for lo, hi in B.row_blocks(offs, 2 * B.PIECE) for x in shingle_sets(b[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])]
        size = np.array([len(x) for x in sets])
        values, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), size)
        many = times[ids] > 1  # the others are in no intersection
        place = (np.cumsum(times > 1) - 1)[ids[many]]
        rows, both = rows[many], np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(place, kind="stable")
        rows, place = rows[order], place[order]
        for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
            p, q = np.searchsorted(place, [lo, lo + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[rows[p:q], place[p:q] - lo] = 1
            both += part @ part.T
        linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)
        links, top = [], {int(c): int(c) for c in comp}
        for i, j in zip(*np.nonzero(np.triu(linked & (comp[:, None] != comp[None, :]), 1))):
            x, y = int(comp[i]), int(comp[j])
            while top[x] != x:
                x = top[x]
            while top[y] != y:
                y = top[y]
            if x != y:
                top[max(x, y)] = min(x, y)
                links.append((int(comp[i]), int(comp[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs. percent: least similarity in hundredths."""
    spark = B.session(docs)
    B.ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = B.store(src.mapInArrow(B.lean(_signatures), SIG), "sig")
    worded = sig.where("n_shingles > 0 and doc_id is not null")
    classes = B.store(worded.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")
    own = F.struct("h1", "h2", "n_shingles")
    again = worded.groupBy("doc_id").agg(F.count("*").alias("rows"), (F.min(own) != F.max(own)).alias("apart")).where("rows > 1").select("doc_id", "apart")
    again = B.store(again, "again")
    repeats = again.count()
    rows = classes.select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("cnt")).where("cnt > 1")
    members = B.store(rows.join(shared, "band"), "members")
    score = members.groupBy("node").agg(F.sum("cnt").alias("score"))
    members = B.store(members.select("band", "node", "n").join(score, "node"), "members")

    nodes = members.select(F.col("node").alias("doc_id")).distinct()
    nodes = B.store(nodes, "nodes")
    texts = src.join(B.bounded_broadcast(nodes, nodes.count()), "doc_id", "left_semi")
    if repeats:  # each text of a repeated id once
        seen = B.bounded_broadcast(again.select("doc_id"), repeats)
        texts = texts.join(seen, "doc_id", "left_anti").union(texts.join(seen, "doc_id", "left_semi").distinct())
    texts = B.store(texts, "texts")

    hubs = members.groupBy("band").agg(F.max(F.struct("score", (-F.col("node")).alias("neg"), "node", "n")).alias("h"))
    hubs = hubs.select("band", F.col("h.node").alias("a"), F.col("h.n").alias("a_n"))
    near = F.expr(f"100 * least(n, a_n) >= {percent} * greatest(n, a_n)")
    edges = B.store(members.join(hubs, "band").where(near & (F.col("node") != F.col("a"))).select("a", F.col("node").alias("b")).distinct(), "edges")
    one, two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    links = B.store(edges.join(one, "b").join(two, "a").select("a", "b", "ta", "tb").mapInArrow(B.lean(_confirm(percent)), "a long, b long"), "links")
    if repeats:  # a document whose texts are in several classes joins them
        several = B.bounded_broadcast(again.where("apart").select("doc_id"), repeats)
        ties = worded.join(several, "doc_id", "left_semi").select("doc_id", "h1", "h2", "n_shingles").distinct().join(classes, ["h1", "h2", "n_shingles"])
        links = links.union(ties.where("doc_id <> rep").select("rep", "doc_id"))
    comps = B.store(B.components(links), "comps")

    # buckets that still hold several components are compared in blocks
    known = members.select("band", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = known.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("k")).where("x <> y")
    rest = known.join(open_.select("band", F.ceil(F.col("k") / BLOCK).alias("blocks")), "band")
    rest = B.store(rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "rest")
    met = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("band", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "node", "comp").join(texts.withColumnRenamed("doc_id", "node"), "node")
    more = B.store(met.groupBy("band", "bi", "bj").applyInArrow(_compare(percent), "a long, b long").distinct(), "links")
    above = B.store(B.components(more), "comps").select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    joined = comps.join(above, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    single = above.join(comps.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("top").alias("comp"))
    comps = joined.union(single)

    merged = classes.select("h1", "h2", "n_shingles", F.col("rep").alias("node"), "copies").join(comps, "node", "left")
    merged = B.store(merged.where("copies > 1 or comp is not null").select("h1", "h2", "n_shingles", F.coalesce("comp", "node").alias("comp")), "merged")
    out = sig.join(merged, ["h1", "h2", "n_shingles"], "left")
    comp = F.coalesce(F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("comp")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 5, 0) + 2)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * met >= 85 * (x.n + y.n - met)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT doc_id, min(reach) AS comp FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.comp AS component_id, d.doc_id = c.comp AS kept
FROM d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
