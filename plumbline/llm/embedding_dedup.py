"""Embedding near-duplicates: iterative quantisation and multi-index Hamming tables.

Contract. Vectors of equal length are linked if their cosine in double precision is at least
`least`; what is null, empty, zero, or holds null or non-finite components links with nothing.
Pairs are retrieved by binary codes and reranked with the original vectors, so no link is below
`least`; retrieval is approximate above it (expected recall 0.97 at the threshold, more above).

Cases: ids are whole numbers, what can't be read as one raises an error; exact copies form one class and are expanded by count alone; each row is a vector of its
own, so rows that repeat an id are linked, counted and kept by their own vectors, equal or not, and share a
component only where links join them; a null id links with nothing; ties at `least` are links; an
empty table gives an empty result; only the id and vector columns are read, so others can't clash.

Scale. The rotation is fitted on a sample of about `sample` classes by hash of the vector; all
vectors are indexed. Code parts are about log2(rows) bits wide, so a bucket holds about
one unrelated vector at any size; the number of tables follows from the threshold and the width. A
vector probes its own bucket and those one bit away in each table. Candidates must be close
in the whole code before any vector is fetched. Buckets of more than HOT vectors emit no pairs:
their probers and owners are compared in blocks of about BLOCK, each block pair a task of its
own that returns one row a vector (its links, and the smallest vector they join it with). A pair
counts in the first such table that it meets in; pairs that meet in one are left out elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base as B

SAMPLE, ROUNDS, MISS = 16384, 30, 0.03
HOT, BLOCK = 32, 1024
FEW, CROWD = 32, 0.8
TAG = 48  # a key holds its table from this bit on


def plan(rows: int, least: float) -> tuple[int, int, int]:
    """Bits of a part, number of tables, and the Hamming limit on the whole code."""
    b = min(30, max(8, math.ceil(math.log2(max(2, rows)))))
    p = math.acos(least) / math.pi
    found = (1 - p) ** b + b * p * (1 - p) ** (b - 1)
    m = max(2, math.ceil(math.log(MISS) / math.log(1 - found))) if found < 1 else 1
    bits = m * b
    return b, m, math.ceil(bits * p + 4.5 * math.sqrt(bits * p * (1 - p)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x: np.ndarray, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Projection (dimensions x bits) and thresholds that make each bit balanced on the sample.

    A group of similar vectors counts as about one, so that no threshold runs through a large one; where
    fewer than FEW are left, all thresholds are 0.
    """
    rng = np.random.default_rng(seed)
    d, parts, cuts = x.shape[1], [], []
    crowd = np.concatenate([(x[lo : lo + 256] @ x.T >= CROWD).sum(axis=1) for lo in range(0, len(x), 256)])
    thin = x[rng.random(len(x)) * crowd < 1]
    few = len(thin) < FEW
    x = x if few else thin
    mean = np.zeros(d) if few else x.mean(axis=0)

    def middle(z: np.ndarray) -> np.ndarray:
        return np.zeros(z.shape[1]) if few else np.median(z, axis=0)

    axes = np.eye(d) if few else np.linalg.eigh(np.cov((x - mean).T).reshape(d, d))[1]
    v = (x - mean) @ axes
    while sum(p.shape[1] for p in parts) < bits:
        r, _ = np.linalg.qr(rng.normal(size=(d, d)))
        for _ in range(ROUNDS):
            z = v @ r
            u, _, wt = np.linalg.svd(np.sign(z - middle(z)).T @ v)
            r = (u @ wt).T
        w = axes @ r
        parts.append(w)
        cuts.append(middle(x @ w))
    return np.concatenate(parts, axis=1)[:, :bits], np.concatenate(cuts)[:bits]


def _padded(col: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    offs = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy()
    sizes = np.diff(offs)
    out = np.zeros((len(col), dims))
    rows = np.repeat(np.arange(len(col)), sizes)
    out[rows, np.arange(offs[0], offs[-1]) - offs[:-1][rows]] = flat[offs[0] : offs[-1]]
    return out, sizes


def _keys(width: int, tables: int, dims: int, model):
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
    flips = np.concatenate([[np.uint64(0)], weights])
    per = 64 // width

    def run(batches):
        w, cut = model.value
        for batch in batches:
            x, sizes = _padded(batch.column(1), dims)
            on = unit(x) @ w > cut
            parts = np.stack([(on[:, t * width : (t + 1) * width] * weights).sum(axis=1, dtype=np.uint64) for t in range(tables)], axis=1)
            packed = np.zeros((len(x), -(-tables // per)), np.uint64)
            for t in range(tables):
                packed[:, t // per] |= parts[:, t] << np.uint64(width * (t % per))
            parts |= np.arange(tables, dtype=np.uint64) << np.uint64(TAG)
            probes = (parts[:, :, None] ^ flips).reshape(len(x), -1)

            def lists(m):
                return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).reshape(-1).view(np.int64)))

            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), lists(packed), lists(parts), lists(probes)], ["node", "dim", "code", "keys", "probes"])

    return run


def _rerank(least: float):
    def run(batches):
        for batch in batches:
            a, b, va, vb = (batch.column(i) for i in range(4))
            if not len(a):
                continue
            oa = va.offsets.to_numpy().astype(np.int64)
            x, y = va.values.to_numpy()[oa[0] : oa[-1]], vb.values.to_numpy()[vb.offsets[0].as_py() : vb.offsets[-1].as_py()]
            at = oa[:-1] - oa[0]
            n = np.diff(oa)
            x = x / np.repeat(np.maximum.reduceat(np.abs(x), at), n)
            y = y / np.repeat(np.maximum.reduceat(np.abs(y), at), n)
            cos = np.add.reduceat(x * y, at) / (np.sqrt(np.add.reduceat(x * x, at)) * np.sqrt(np.add.reduceat(y * y, at)))
            keep = pa.array(np.flatnonzero(cos >= least))
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], ["a", "b"])

    return run


def _dense(least: float, width: int):
    """Links between the probers (side 0) and owners (side 1) of a hot bucket's block pair, summed by vector."""
    per, mask = 64 // width, np.uint64((1 << width) - 1)

    def run(table: pa.Table) -> pa.Table:
        side, node, dim, copies = (table.column(c).to_numpy() for c in ("side", "node", "dim", "copies"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x = unit(_padded(table.column("v").combine_chunks(), int(dim.max()))[0])
        cos = x[left] @ x[right].T
        for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12)):  # the same whatever the block
            cos[i, j] = math.fsum(x[left[i]] * x[right[j]])
        i, j = np.nonzero((cos >= least) & (node[left][:, None] < node[right]) & (dim[left][:, None] == dim[right]))
        i, j = left[i], right[j]
        code = table.column("code").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        lists = table.column("hot").combine_chunks()
        tables = int(table.column("key")[0].as_py()) >> TAG
        hot = np.zeros((len(node), per * code.shape[1]), bool)
        hot[np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
        for t in range(tables):
            part = (code[:, t // per] >> np.uint64(width * (t % per))) & mask
            far = part[i] ^ part[j]
            new = ~hot[j, t] | ((far & (far - np.uint64(1))) != 0)
            i, j = i[new], j[new]
        nodes, at = np.unique(node, return_inverse=True)
        p, q = at[i], at[j]
        n = np.bincount(p, weights=copies[j], minlength=len(nodes)) + np.bincount(q, weights=copies[i], minlength=len(nodes))
        top = np.arange(len(nodes))
        while (top[p] != top[q]).any():
            least_top = np.minimum(top[p], top[q])
            new = top.copy()
            np.minimum.at(new, top[p], least_top)
            np.minimum.at(new, top[q], least_top)
            top = new[new]
        on = n > 0
        return pa.table({"node": nodes[on], "n": n[on].astype(np.int64), "top": nodes[top[on]]})

    return run


def _hot_links(coded: DataFrame, hot: DataFrame, classes: DataFrame, least: float, width: int) -> DataFrame:
    """(node, n, top) rows of all links between a vector and the owners of the hot buckets (key, owners) that it probes."""
    found = B.bounded_broadcast(hot, hot.count())
    probing = coded.select("node", F.explode("probes").alias("key")).join(found, "key")
    probing = B.store(probing, "probing")
    size = probing.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("li"), F.ceil(F.first("owners") / BLOCK).alias("ri"))
    size = B.store(size, "blocks")
    size = B.bounded_broadcast(size, size.count())
    own = coded.select("node", F.explode("keys").alias("key")).join(size, "key")

    def every(blocks: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    def block(blocks: str):
        return F.pmod(F.xxhash64("node"), F.col(blocks))

    left = probing.select("key", "node").join(size, "key").select("key", "node", F.lit(0).alias("side"), block("li").alias("i"), every("ri").alias("j"))
    right = own.select("key", "node", F.lit(1).alias("side"), every("li").alias("i"), block("ri").alias("j"))
    members = left.union(right).join(coded.select("node", "dim", "code", "hot"), "node").join(classes.select("node", "v", "copies"), "node")
    return members.groupBy("key", "i", "j").applyInArrow(_dense(least, width), "node long, n long, top long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors."""
    spark = B.session(vectors)
    B.ship(spark)
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    src = src.withColumn("v", F.when(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)), F.col("v")))
    classes = B.store(src.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    rows, dims = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not rows:
        return src.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width, tables, limit = plan(rows, least)
    every = max(1, rows // sample)
    got = classes.where(F.pmod(F.xxhash64("v"), F.lit(every)) == 0).select("v").toArrow().column("v").combine_chunks()
    if len(got) < 2:
        got = classes.select("v").limit(2).toArrow().column("v").combine_chunks()
    x, _ = _padded(got, dims)
    x = x[np.lexsort(x.T)]  # the same model whatever the order of rows
    model = spark.sparkContext.broadcast(fit(unit(x), width * tables))  # dims x bits, whatever the input
    coded = B.store(classes.select("node", "v").mapInArrow(B.lean(_keys(width, tables, dims, model)), "node long, dim int, code array<long>, keys array<long>, probes array<long>"), "codes")
    owners = coded.select("node", F.explode("keys").alias("key"))
    hot = B.store(owners.groupBy("key").agg(F.count("*").alias("owners")).where(F.col("owners") > HOT), "hot")
    table = F.shiftright("key", TAG).cast("int")
    marks = owners.join(B.bounded_broadcast(hot, hot.count()), "key").groupBy("node").agg(F.collect_list(table).alias("hot"))
    coded = B.store(coded.join(marks, "node", "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<int>"))), "codes")
    dense = B.store(_hot_links(coded, hot, classes, least, width), "dense")
    cold = F.filter("keys", lambda k: ~F.array_contains("hot", F.shiftright(k, TAG).cast("int")))
    left = coded.select(F.col("node").alias("a"), "dim", F.col("code").alias("ca"), F.explode("probes").alias("key"))
    right = coded.select(F.col("node").alias("b"), F.col("dim").alias("dim_b"), F.col("code").alias("cb"), "hot", F.explode(cold).alias("key"))
    per = 64 // width
    apart = sum((F.bit_count(F.element_at("ca", i + 1).bitwiseXOR(F.element_at("cb", i + 1))) for i in range(-(-tables // per))), F.lit(0))
    differ = f"shiftright(element_at(ca, cast(t div {per} as int) + 1) ^ element_at(cb, cast(t div {per} as int) + 1), (t % {per}) * {width}) & {(1 << width) - 1}L"
    counted = F.expr(f"exists(hot, t -> bit_count({differ}) <= 1)")
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("dim") == F.col("dim_b")) & (apart <= limit) & ~counted).select("a", "b").distinct()
    one, two = classes.select(F.col("node").alias("a"), F.col("v").alias("va")), classes.select(F.col("node").alias("b"), F.col("v").alias("vb"))
    links = pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb").mapInArrow(B.lean(_rerank(least)), "a long, b long")
    links = B.store(links, "links")
    comps = B.components(links.union(dense.where("node <> top").select("top", "node")))
    size = classes.select("node", "copies")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("copies").alias("n"))
    degree = degree.union(dense.select("node", "n")).groupBy("node").agg(F.sum("n").alias("others"))
    # a component is named by the smallest id of its classes
    ids = classes.select("node", "rep")
    named = comps.join(ids, "node").groupBy("comp").agg(F.min("rep").alias("least_id"))
    comps = comps.join(named, "comp").select("node", "least_id")
    facts = classes.join(degree, "node", "left").join(comps, "node", "left")
    facts = facts.select("v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("least_id", "rep").alias("comp")).where("n > 0")
    facts = B.store(facts, "facts")
    out = src.join(facts, "v", "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
u AS (SELECT * FROM v WHERE len(list_filter(x, lambda t: t IS NULL OR NOT isfinite(t))) = 0 AND len(list_filter(x, lambda t: t <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT vec_id, min(reach) AS comp FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp AS component_id, c.vec_id = comp AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""
