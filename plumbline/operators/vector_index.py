"""A stored index of vectors: coarse lists by k-means, of which a query reads the nearest, ranked with the vectors themselves.

`build` learns the centres on a bounded sample, gives every vector to its nearest centre by cosine, and stores the vectors
partitioned by list. `search` deals each query to its nearest lists, reads only the lists that some query asks for (partition
pruning), and computes exact similarities within them; what it returns is right, but a match in a list that wasn't asked for is missed. How
many lists are asked for is chosen at the build: the fewest that give TARGET of the exact matches between the vectors of the sample.
`corpus.similar` is the exact search.

Vectors that can't be compared with a centre (null or not finite numbers, zero, another length than most) are in a list of their own,
which every query reads; of these only what an exact search returns is returned. A list with a third of all vectors (copies) is
many blocks, each a task's work.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import corpus as C
from plumbline.sources import shared

#: vectors to learn from at most, of them queries to choose the number of lists by, lists at most, rounds of k-means
SAMPLE, TUNED, LISTS, ROUNDS = 16_384, 512, 4096, 10
TARGET, COUNT = 0.97, 10
APART = -1  # the list of what has no nearest centre


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _centres(x: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means: unit centres of unit vectors, begun with vectors far apart."""
    rng = np.random.default_rng(7)
    at, near = [int(rng.integers(len(x)))], np.full(len(x), -1.0)
    while len(at) < lists:
        near = np.maximum(near, x @ x[at[-1]])
        far = np.maximum(1 - near, 0) + 1e-12
        at.append(int(rng.choice(len(x), p=far / far.sum())))
    centres = x[at]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(axis=1))
        centres = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def _probes(x: np.ndarray, centres: np.ndarray, target: float) -> int:
    """The fewest lists to ask for that give the target share of the best COUNT of the sample's own queries."""
    asked = x[:: max(1, len(x) // TUNED)][:TUNED]
    own = np.argmax(x @ centres.T, axis=1)
    sim = asked @ x.T
    best = np.argpartition(-sim, min(COUNT, len(x) - 1), axis=1)[:, : COUNT + 1]
    order = np.argsort(-(asked @ centres.T), axis=1)
    place = np.argsort(order, axis=1)  # of each list for each query
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def _comparable(c: Column, size: int) -> Column:
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(c, lambda v: v != 0)
    return F.coalesce((F.size(c) == size) & sound, F.lit(False))


def _nearest(column: str, names: list[str], centres: np.ndarray, probes: int):
    """Rows with an array of their `probes` nearest lists; of vectors that can't be compared, none."""
    size = centres.shape[1]
    flat = np.ascontiguousarray(centres.T)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            v, good = batch.column(names.index(column)), batch.column(names.index("__good")).to_numpy(False)
            rows = np.flatnonzero(good)
            lists = np.zeros((len(rows), probes), np.int32)
            for lo in range(0, len(rows), 4096):
                part = rows[lo : lo + 4096]
                score = v.take(pa.array(part)).flatten().to_numpy(False).reshape(-1, size) @ flat
                lists[lo : lo + len(part)] = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            counts = np.where(good, probes, 0)
            made = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(lists.ravel()))
            kept = [batch.column(i) for i, n in enumerate(names) if n != "__good"]
            yield pa.RecordBatch.from_arrays([*kept, made], [*[n for n in names if n != "__good"], "lists"])

    return run


def _listed(df: DataFrame, column: str, centres: np.ndarray, probes: int) -> DataFrame:
    rows = df.withColumn(column, F.col(column).cast("array<double>")).withColumn("__good", _comparable(F.col(column), centres.shape[1]))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "__good"], T.StructField("lists", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_nearest(column, rows.columns, centres, probes), schema)


def _drawn(rows: DataFrame, column: str, n: int, sample: int) -> DataFrame:
    """Those `sample` rows of n whose hashes are the smallest, the same in every run; equal rows count once.

    A task of an ordered limit sends up to `sample` rows to the driver, so all but a quarter more than those wanted are left out
    before, by their hash.
    """
    low, span = -(1 << 63), 1 << 64
    own = F.xxhash64(*[f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()])
    hashed = rows.select(column, own.alias("__hash"))
    share = 1.25 * sample / n if n else 1.0
    if share < 1:
        hashed = hashed.where(F.col("__hash") < low + int(share * span))
    return hashed.dropDuplicates(["__hash"]).orderBy("__hash").limit(sample).select(column)


def build(chunks: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, target: float = TARGET, column: str = "embedding") -> dict:
    """Store chunks at path by lists; returns what is stored beside them: centres, and the number of lists to ask for.

    lists: how many, by default the root of the number of rows and at most LISTS; sample: vectors to learn from.
    """
    spark = chunks.sparkSession
    rows = chunks.withColumn(column, F.col(column).cast("array<double>"))
    sizes = rows.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dims, n = (sizes.d, sizes.n) if sizes else (1, 0)
    x = np.array([r[0] for r in _drawn(rows.where(_comparable(F.col(column), dims)), column, n, sample).collect()], float).reshape(-1, dims)  # `sample` rows at most
    x = _unit(x) if len(x) else x
    k = max(1, min(lists or int(np.sqrt(n)) or 1, LISTS, len(x) or 1))
    centres = _centres(x, k) if len(x) else np.zeros((1, dims))
    meta = {"centres": centres.tolist(), "probes": _probes(x, centres, target) if len(x) else 1, "column": column, "dims": dims}
    dealt = _listed(chunks, column, centres, 1).withColumn("list", F.coalesce(F.try_element_at("lists", F.lit(1)), F.lit(APART))).drop("lists")
    dealt.limit(0).write.mode("overwrite").parquet(f"{path}/shape")
    dealt.repartition("list", F.pmod(F.xxhash64(column), F.lit(-(-n // (k * 4 * C.BLOCK)) or 1))).write.partitionBy("list").mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return meta


def search(spark: SparkSession, path: str, queries: DataFrame, threshold: float = 0.5, count: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank) of the most similar stored chunks above the threshold, ties by id, in the lists asked for.

    queries: (query_id, q). probes: lists that a query asks for, by default what the build chose. A query that can't be compared asks
    for all of them.
    """
    meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
    centres, column = np.array(meta["centres"]), meta["column"]
    probes = max(1, min(probes or meta["probes"], len(centres)))
    asked = shared.stored(_listed(queries.select("query_id", "q"), "q", centres, probes), "queries")
    own = F.when(F.size("lists") > 0, F.concat("lists", F.array(F.lit(APART)))).otherwise(F.sequence(F.lit(APART), F.lit(len(centres) - 1)))
    asked = asked.select("query_id", "q", F.explode(own).alias("list"))
    wanted = [r.list for r in asked.select("list").distinct().collect()]  # LISTS + 1 at most
    shape = spark.read.parquet(f"{path}/shape").schema  # an empty index has no other file
    stored = spark.read.schema(shape).parquet(f"{path}/lists").where(F.col("list").isin(wanted)).withColumnRenamed(column, "embedding")
    return C.similar_by(asked, stored, "list", threshold, count)
