"""Code text: sections, chunks, retrieval, citations and rule drafts."""

from __future__ import annotations

import functools
import itertools
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.operators import dictionary as D
from plumbline.operators import scan as S
from plumbline.sources import shared

# fixed values: what a heading line looks like
HEADING = r"^\s*(\d+(?:\.\d+){1,4})\s+(.{2,160}?)\s*$"
ARTICLE = r"(?i)^\s*Article\s+(\d+(?:\.\d+){0,4})\s*[—:-]?\s*(.{2,160}?)\s*$"
# fixed values: the five retrieval categories
CATEGORIES = {
    "egress": "egress width requirements corridor minimum exit access travel distance",
    "doors": "door width swing direction fire-rated assembly opening protectives",
    "corridors": "corridor width dead-end length fire separation public corridor",
    "stairs": "stair width rise run handrail guardrail headroom landing requirements",
    "occupancy": "occupancy classification group major occupancy load building area limits",
}


def sections(docs: DataFrame, key: str, text: str, block: int | None = None) -> DataFrame:
    """(key, ordinal, section_id, section_title, content): lines gathered under the heading above them.

    block: lines of a long document that one task numbers.
    """
    long = (S.breaks(F.col(text)) >= (block or S.SIZE)).alias("__many")
    lines = docs.select(key, long, text).select(key, "__many", F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).withColumn("line", F.replace("line", F.lit("\u00a0"), F.lit(" ")))
    by_id = F.coalesce(X.blank_null(F.regexp_extract("line", HEADING, 1)), X.blank_null(F.regexp_extract("line", ARTICLE, 1)))
    title = F.when(F.col("line").rlike(HEADING), F.regexp_extract("line", HEADING, 2)).otherwise(F.regexp_extract("line", ARTICLE, 2))
    lines = lines.withColumn("sid", by_id).withColumn("title", X.trim(title))
    lines = S.carried(lines, key, "pos", F.col("__many"), {"ordinal": F.col("sid").isNotNull()}, {}, block)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("sid").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy(key, "ordinal").agg(F.max("sid").alias("section_id"), F.max(F.when(F.col("sid").isNotNull(), F.col("title"))).alias("section_title"), X.trim(body).alias("content"))
    return out.where("content <> ''").select(key, "ordinal", F.coalesce("section_id", F.lit("preamble")).alias("section_id"), F.coalesce("section_title", F.lit("Preamble")).alias("section_title"), "content")


def _packs(limit: int):
    """Numbers of the paragraphs that open a part, from the paragraphs' lengths: a walk from break to break over their sums."""

    def run(sizes: pd.Series) -> pd.Series:
        import numpy as np

        def one(n):
            total = np.cumsum(np.asarray(n, np.int64) + 2)
            starts, at = [], 0
            while at < len(total):
                starts.append(at)
                base = total[at - 1] if at else 0
                at = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            return starts

        return sizes.map(one)

    return F.pandas_udf(run, "array<int>")


def split_oversized(found: DataFrame, max_tokens: int = 500) -> DataFrame:
    """Sections over the limit as greedily packed paragraphs #1, #2, ...; one paragraph is never cut.

    A part takes paragraphs while their lengths, and two for each, stay within the limit. Only lengths go to Python.
    """
    small = X.approx_tokens(F.col("content")) <= max_tokens
    paragraphs = F.split("content", r"\n\s*\n")
    keep = [c for c in found.columns if c != "content"]
    whole = found.where(F.coalesce(small, F.lit(True))).select(*keep, F.lit(1).alias("__n"), F.lit(0).alias("__k"), "content")
    large = found.where(~small).select(*keep, paragraphs.alias("__p"))
    starts = _packs(max_tokens * 4)(F.transform("__p", lambda p: F.length(p)))
    large = large.select(*keep, "__p", starts.alias("__s"))
    ends = F.concat(F.slice("__s", 2, F.size("__s")), F.array(F.size("__p")))
    parts = F.zip_with("__s", ends, lambda a, z: X.trim(F.array_join(F.slice("__p", a + 1, z - a), "\n\n")))
    large = large.select(*keep, F.filter(parts, lambda x: x != "").alias("__parts"))
    large = large.select(*keep, F.size("__parts").alias("__n"), F.posexplode("__parts").alias("__k", "content"))
    rows = whole.union(large)
    ident = F.when(F.col("__n") > 1, F.concat("section_id", F.lit("#"), (F.col("__k") + 1).cast("string"))).otherwise(F.col("section_id"))
    return rows.withColumn("section_id", ident).select(*found.columns)


def cosine(a: str, b: str) -> Column:
    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)

    dot = total(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y))
    norms = [F.sqrt(total(F.transform(F.col(c).cast("array<double>"), lambda x: x * x))) for c in (a, b)]
    return F.try_divide(dot, norms[0] * norms[1])


# fixed values: between blocks, and where there are none
BETWEEN, NONE_FOUND = "\n\n---\n\n", "(no code sections retrieved)"
#: rows packed into one block, queries that may be broadcast, and matches a task holds before it passes them on
BLOCK, BROADCAST, HELD = 1024, 20_000, 1 << 18
#: blank cited texts in one array
CITED = 256


def _packed(df: DataFrame, key: str | None = None) -> DataFrame:
    """df in blocks of at most BLOCK rows, each an Arrow stream in one binary; with a whole number as key, (key, block) for runs of each key."""
    size = BLOCK
    columns = [c for c in df.columns if c != key]
    if key:
        df = df.select(key, *columns).sortWithinPartitions(key)

    def run(batches):
        import pyarrow as pa

        def row(parts):
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(parts)
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table.combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

        def blocks(batches):
            held, n = [], 0
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    part = batch.slice(at, size - n)
                    held, n, at = [*held, part], n + part.num_rows, at + part.num_rows
                    if n == size:
                        yield row(held)
                        held, n = [], 0
            if held:
                yield row(held)

        if not key:
            yield from blocks(batches)
            return
        for k, run_of in itertools.groupby(((k, part) for batch in batches for k, part in runs(batch)), lambda x: x[0]):
            for block in blocks(part for _, part in run_of):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), block.column(0)], [key, "block"])

    def runs(batch):
        import numpy as np
        import pyarrow as pa

        own = batch.column(0).cast(pa.int64()).to_numpy(False)
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1), len(own)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield int(own[lo]), batch.slice(lo, hi - lo).select(columns)

    return df.mapInArrow(run, f"`{key}` long, block binary" if key else "block binary")


def _best(threshold: float, count: int, names: list[str]):
    """Over pairs of blocks: each query's best matches, ties by id, among all chunks that this task has met."""
    limit = HELD

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def opened(raw, vector):
            table = pa.ipc.open_stream(raw).read_all().combine_chunks()
            v = table.column(vector).combine_chunks()
            n = np.where(v.is_null().to_numpy(False), 0, v.value_lengths().fill_null(0).to_numpy(False))
            flat = v.flatten()
            whole = np.ones(len(v), bool)
            whole[np.repeat(np.arange(len(v)), n)[flat.is_null().to_numpy(False)]] = False  # a null makes the similarity null
            start = np.concatenate([[0], np.cumsum(n)])
            return table.drop_columns([vector]), flat.fill_null(0.0).to_numpy(False), start, np.where(whole, n, 0)

        def norms(x):
            total = np.zeros(len(x))
            for j in range(x.shape[1]):
                total += x[:, j] * x[:, j]
            return np.sqrt(total)

        @np.errstate(all="ignore")
        def matches(q, c):
            """Positions and similarities, summed in the order of the elements as SQL does."""
            (_, xs, xa, xn), (_, ys, ya, yn) = q, c
            for d in set(xn) & set(yn) - {0}:
                right = np.flatnonzero(yn == d)
                y = np.ascontiguousarray(ys[ya[right][:, None] + np.arange(d)].T)
                size = norms(y.T)
                rows = np.flatnonzero(xn == d)
                for left in (rows[k : k + 64] for k in range(0, len(rows), 64)):
                    x = xs[xa[left][:, None] + np.arange(d)]
                    dot, one = np.zeros((len(left), len(right))), np.empty((len(left), len(right)))
                    for j in range(d):
                        dot += np.multiply(x[:, j, None], y[j], out=one)
                    over = norms(x)[:, None] * size
                    sim = dot / over
                    some = ((sim > threshold) | np.isnan(sim)) & (over != 0)
                    for r in range(len(left)):
                        at = np.flatnonzero(some[r])
                        if len(at) > count:  # chunks are sorted by id
                            at = at[np.argsort(-np.where(np.isnan(sim[r, at]), np.inf, sim[r, at]), kind="stable")[:count]]
                        yield np.full(len(at), left[r]), right[at], sim[r, at]

        def reduced(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            query = pc.dictionary_encode(table.column("query_id"), null_encoding="encode").combine_chunks().indices.to_numpy(False)
            sim = table.column("similarity").to_numpy()
            ids = pc.rank(table.column("id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(False)
            order = np.lexsort((ids, -np.where(np.isnan(sim), np.inf, sim), query))
            own = query[order]
            first = np.searchsorted(own, own)
            return table.take(pa.array(order[np.arange(len(own)) - first < count])).combine_chunks().to_batches()

        held, n, last = [], 0, (None, None)
        for batch in batches:
            for qb, cb in zip(batch.column(0), batch.column(1)):
                raw = cb.as_buffer()
                if last[0] is None or not raw.equals(last[0]):
                    table, flat, start, size = opened(raw, "embedding")
                    order = pc.array_sort_indices(table.column("id").combine_chunks(), null_placement="at_start")
                    at = order.to_numpy(False)
                    last = raw, (table.take(order), flat, start[:-1][at], size[at])
                q, c = opened(qb.as_buffer(), "q"), last[1]
                found = list(matches(q, c))
                if not found:
                    continue
                i, j, sim = (np.concatenate(x) for x in zip(*found))
                left, right = q[0].take(pa.array(i)), c[0].take(pa.array(j))
                cols = {**dict(zip(right.column_names, right.columns)), **dict(zip(left.column_names, left.columns)), "similarity": pa.chunked_array([sim])}
                held += pa.table({k: cols[k] for k in names}).combine_chunks().to_batches()
                n += len(i)
                if n > limit:
                    held = reduced(held)
                    n = sum(b.num_rows for b in held)
                    if 2 * n > limit:
                        yield from held
                        held, n = [], 0
        if n:
            yield from reduced(held)

    return run


def similar(queries: DataFrame, chunks: DataFrame, threshold: float = 0.5, count: int = 10) -> DataFrame:
    """(query_id, id, similarity, rank) of the most similar chunks above the threshold, ties by id.

    queries: (query_id, q), any number of them. Blocks of queries meet blocks of chunks; a task passes on
    the best `count` of each query, and only those reach the window. Up to BROADCAST queries are broadcast.
    """
    n = queries.count()
    few = n <= BROADCAST
    queries, chunks, schema = _as_doubles(queries, chunks)
    left, right = _packed(chunks).toDF("chunks"), _packed(queries.repartition(n // 128 + 1) if few else queries.repartition("query_id")).toDF("queries")
    met = left.crossJoin(F.broadcast(right) if few else right).select("queries", "chunks")
    return _ranked(met, threshold, count, schema)


def similar_by(queries: DataFrame, chunks: DataFrame, key: str, threshold: float = 0.5, count: int = 10) -> DataFrame:
    """The same where a query meets only the chunks with one of its keys, whole numbers. queries: (query_id, q, key), a row for each key."""
    n = queries.count()
    queries, chunks, schema = _as_doubles(queries, chunks)
    schema = T.StructType([f for f in schema.fields if f.name != key])
    right = _packed(queries.repartition(key), key).toDF(key, "queries")
    # a query is a row for each of its keys, of which Spark's own estimate knows nothing: without the hint it would broadcast them all
    met = _packed(chunks, key).toDF(key, "chunks").join(F.broadcast(right) if n <= BROADCAST else right.hint("merge"), key).select("queries", "chunks")
    return _ranked(met, threshold, count, schema)


def _as_doubles(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, T.StructType]:
    """Both with vectors of doubles, and what their matches hold."""
    queries, chunks = queries.withColumn("q", F.col("q").cast("array<double>")), chunks.withColumn("embedding", F.col("embedding").cast("array<double>"))
    once = {f.name: f for f in [*chunks.schema.fields, *queries.schema.fields] if f.name not in ("q", "embedding")}
    return queries, chunks, T.StructType([*once.values()]).add("similarity", "double")


def _ranked(met: DataFrame, threshold: float, count: int, schema: T.StructType) -> DataFrame:
    best = met.mapInArrow(_best(threshold, count, schema.names), schema)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")))
    return ranked.where(F.col("rank") <= count)


def match_chunks(queries: DataFrame, chunks: DataFrame, threshold: float = 0.5, count: int = 10) -> DataFrame:
    """match_code_chunks for each row of a table: (query_id, id, section_id, section_title, content, similarity), ties by id as text.

    queries: (query_id, q), each id once. Blocks of vectors are compared as in similar, where a lateral call of the SQL function
    makes a row for each query and chunk.
    """
    named = chunks.withColumn("id", F.col("id").cast("string"))
    best = similar(queries.select("query_id", "q"), named.select("id", "section_id", "section_title", "content", "embedding"), threshold, count)
    return best.select("query_id", "id", "section_id", "section_title", "content", "similarity")


def similar_in_part(queries: DataFrame, chunks: DataFrame, prefix: str | None, k: int, threshold: float) -> DataFrame:
    """Over-fetch, keep the sections of a part, fall back to the unfiltered ranking where none is left."""
    if not prefix:
        return similar(queries, chunks, threshold, k)
    wide = similar(queries, chunks, threshold, max(8 * k, 40)).withColumn("own", F.coalesce(F.col("section_id"), F.lit("")).startswith(prefix))
    wide = wide.withColumn("any_own", F.max("own").over(W.partitionBy("query_id"))).where("own or not any_own")
    return wide.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k).drop("own", "any_own")


def keyword_search(queries: DataFrame, chunks: DataFrame, limit: int, prefix: str | None = None, index: str | None = None) -> DataFrame:
    """(query_id, id, rank): chunks that hold any of a query's terms in content or title, first by id.

    queries: (query_id, query), or (query_id, query, prefix) where each has a prefix of its own, or null. A term is a run
    of ASCII letters and digits, so it lies within one such run of a text: terms meet the distinct runs of all chunks, and
    chunks join those runs that hold one. index: where keyword_index has stored these chunks; it is read in place of their texts.
    Of a term's runs, those whose first chunk is behind as many others as are asked for can't give one of the first, and aren't joined.
    """
    own = ["prefix"] if "prefix" in queries.columns else []
    terms = queries.select("query_id", *own, F.explode(X.keyword_terms(F.col("query"))).alias("term"))
    pool = chunks.where(F.col("section_id").startswith(prefix)) if prefix else chunks
    section = ["section_id"] * (bool(own) or bool(index and prefix))
    rows = D.words(pool, ["id", *section], _low_chunk(), D.KEYWORD_GAP, X.TERM)
    vocabulary = chunks.sparkSession.read.parquet(f"{index}/words") if index else shared.stored(D.vocabulary(rows, "id"), "vocabulary")
    met = shared.stored(D.holding(terms.select(F.col("term").alias("text")), vocabulary), "matches").withColumnRenamed("text", "term")
    long = F.length("term") > D.OVERLAP + 1
    if own or index and prefix:  # a run's first chunk may be of another section
        met = met.select("term", "word", F.lit(None).cast(vocabulary.schema["first"].dataType).alias("last"))
    else:  # nor may it hold the rest of a long term
        met = _to_last(met.withColumn("first", F.when(~long, F.col("first"))), ["term"], "first", limit)
        met = shared.stored(met.select("term", "word", "last"), "matches")
    held = D.postings(chunks.sparkSession, index, met) if index else rows
    if index and prefix:
        held = held.where(F.col("section_id").startswith(prefix))
    found = held.join(D.few(met), "word").where(_within("id")).select("id", *section, "term")
    if not terms.where(long).isEmpty():  # only their beginning was looked up
        texts = pool.select(F.col("id").alias("own_id"), _low_chunk().alias("low"))
        sure = found.where(long).join(texts, F.col("id").eqNullSafe(F.col("own_id")) & F.contains("low", "term"))
        found = found.where(~long).unionByName(sure.select(*found.columns))
    if own:
        found = found.join(D.few(terms.select("term", "prefix").distinct()), "term").where(F.col("prefix").isNull() | F.coalesce("section_id", F.lit("")).startswith(F.col("prefix")))
    # a query's first chunks are among the first of its terms; few rows beyond them are sorted
    found = _to_last(shared.stored(found.select("id", "term", *own), "found"), ["term", *own], "id", limit).drop("last")
    first = found.withColumn("n", F.dense_rank().over(W.partitionBy("term", *own).orderBy("id"))).where(F.col("n") <= limit).select("id", "term", *own).distinct()
    same = F.col("f.term") == F.col("t.term")
    same = same & F.col("f.prefix").eqNullSafe(F.col("t.prefix")) if own else same
    found = first.alias("f").join(terms.alias("t"), same).select("t.query_id", "f.id").distinct()
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("id"))).where(F.col("rank") <= limit)


def _to_last(df: DataFrame, keys: list[str], c: str, limit: int) -> DataFrame:
    """df with last, a bound on the first limit values of c for each of keys, without rows beyond it; null, and no bound, where few values were seen.

    Values are dealt to eight cells for each one wanted; the least ones of the cells differ, so the first limit values are no greater
    than the limit-th of them. Rows are only summed up for that, not sorted.
    """
    cell = F.pmod(F.xxhash64(c), F.lit(8 * max(limit, 1)))
    least = df.where(F.col(c).isNotNull()).groupBy(*keys, cell.alias("__cell")).agg(F.min(c).alias("last"))
    last = least.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy("last"))).where(F.col("__n") == limit)
    last = last.select(*[F.col(k).alias(f"__{k}") for k in keys], "last")
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(D.few(last), same, "left").where(_within(c)).select(*df.columns, "last")


def _within(c: str) -> Column:
    return F.col("last").isNull() | F.col(c).isNull() | (F.col(c) <= F.col("last"))


def _low_chunk() -> Column:
    return F.lower(F.concat_ws("\n", "content", "section_title"))


def keyword_index(chunks: DataFrame, path: str) -> None:
    """Store the dictionary of chunks (id, section_id, section_title, content) for keyword_search."""
    D.build(chunks, ["id", "section_id"], _low_chunk(), D.KEYWORD_GAP, path, X.TERM)


def category_queries(sheets: DataFrame, key: str) -> DataFrame:
    """(key, category, place, query_id, query, prefix): the retrieval queries of each sheet, with the hint of its code part.

    sheets: key, occupancy_type, building_type. Sheets of one part share their queries: query_id stands for the text.
    """
    part = X.building_part(F.col("occupancy_type"), F.col("building_type"))
    every = F.posexplode(F.array(*[F.struct(F.lit(k).alias("category"), F.lit(q).alias("words")) for k, q in CATEGORIES.items()])).alias("place", "c")
    rows = sheets.select(key, X.part_hint(part).alias("hint"), X.part_prefix(part).alias("prefix"), every)
    rows = rows.withColumn("query", F.concat("hint", "c.words"))
    return rows.select(key, F.col("c.category").alias("category"), "place", F.col("query").alias("query_id"), "query", "prefix")


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """(query_id, id, section_id, rank, path): what each query retrieves.

    queries: (query_id, query, q, prefix), q null where no vector is at hand; chunks: (id, section_id, section_title, content,
    embedding). Vectors fetch more than k where a prefix is set, and keep those of the prefix, or all if none is; a
    query that no vector answers falls back on its keywords within its prefix.
    """
    wide = max(8 * k, 40)
    asked = queries.where("q is not null").select("query_id", "q", "prefix")
    near = similar(asked, chunks.select("id", "section_id", "embedding"), threshold, wide)
    near = near.where(F.col("prefix").isNotNull() | (F.col("rank") <= k))
    own = F.coalesce(F.coalesce(F.col("section_id"), F.lit("")).startswith(F.col("prefix")), F.lit(True))
    near = near.withColumn("own", own).withColumn("any_own", F.max("own").over(W.partitionBy("query_id"))).where("own or not any_own")
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)
    near = near.select("query_id", "id", "section_id", "rank", F.lit("vector").alias("path"))
    rest = queries.join(near.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "query", "prefix")
    words = keyword_search(rest, chunks.select("id", "section_id", "section_title", "content"), k)
    words = words.join(chunks.select("id", "section_id"), "id").select("query_id", "id", "section_id", "rank", F.lit("keyword").alias("path"))
    return near.unionByName(words)


def retrieve_for_sheets(sheets: DataFrame, vectors: DataFrame, chunks: DataFrame, key: str, k: int = 8, threshold: float = 0.3) -> DataFrame:
    """(key, id, section_id, category, rank, path): a sheet's chunks over all categories, each once, where first found.

    vectors: (query, q), the embedded query texts; a text without one is searched by its keywords.
    """
    part = F.coalesce(X.building_part(F.col("occupancy_type"), F.col("building_type")), F.lit(""))
    own = sheets.select(key, "occupancy_type", "building_type", part.alias("__part"))
    kinds = own.groupBy("__part").agg(F.first(F.struct("occupancy_type", "building_type")).alias("u")).select("__part", "u.*")
    asked = category_queries(kinds, "__part")  # a few queries for each code part, however many sheets
    found = retrieve(asked.select("query_id", "query", "prefix").distinct().join(vectors, "query", "left"), chunks, k, threshold)
    found = asked.select("__part", "category", "place", "query_id").join(found, "query_id")
    once = first_seen(found, ["__part", "id"], ["place", "rank"])
    # k rows at most for each of a few parts and five categories
    return own.select(key, "__part").join(F.broadcast(once), "__part").select(key, "id", "section_id", "category", "rank", "path")


def register_match(spark, view: str = "building_code_chunks") -> None:
    """The SQL table function match_code_chunks(query_embedding, match_threshold, match_count) over a view of chunks; match_chunks is for many queries."""
    def total(x: str) -> str:
        return f"aggregate({x}, 0D, (s, t) -> s + t)"

    def size(v: str) -> str:
        return f"sqrt({total(f'transform(cast({v} as array<double>), t -> t * t)')})"

    dot = total("zip_with(cast(embedding as array<double>), cast(query_embedding as array<double>), (x, y) -> x * y)")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION match_code_chunks(query_embedding ARRAY<FLOAT>, match_threshold DOUBLE DEFAULT 0.5D, match_count INT DEFAULT 10)
        RETURNS TABLE(id STRING, section_id STRING, section_title STRING, content STRING, similarity DOUBLE) RETURN
        SELECT id, section_id, section_title, content, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS n FROM
        (SELECT cast(id as string) AS id, section_id, section_title, content, try_divide({dot}, {size('embedding')} * {size('query_embedding')}) AS similarity FROM {view}) WHERE similarity > match_threshold) WHERE n <= match_count""")


def cited_in(cited: DataFrame, docs: DataFrame, column: str, text: str) -> DataFrame:
    """cited with `found`: whether its text occurs in any document, whatever the case; null is not found.

    A text without white space is looked up among the distinct words of all documents. Of one with white space the longest
    piece is, and the documents with a word that holds it are searched for the whole; so are those that may hold a text longer than
    the windows of long words share. Texts of nothing but white space, arrays of about CITED of them, are searched for everywhere.
    """
    once = cited.select(F.lower(column).alias("text")).where("text is not null").distinct()
    pieces = F.filter(F.split("text", D.BLANK_GAP), lambda p: p != "")
    longest = F.array_sort(F.transform(pieces, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("piece"))))
    asked = shared.stored(once.select("text", F.try_element_at(longest, F.lit(1)).getField("piece").alias("piece")), "cited")
    body = F.lower(text)
    texts = docs.where(F.col(text).isNotNull())
    words = D.words(texts, [F.xxhash64(body).alias("k"), F.xxhash64(F.lit(1), body).alias("k2")], body, D.BLANK_GAP)
    vocabulary = shared.stored(words.select("word").distinct(), "vocabulary")
    met = shared.stored(D.holding(asked.where("piece is not null").select(F.col("piece").alias("text")), vocabulary).withColumnRenamed("text", "piece"), "matches")
    met = asked.join(met, "piece")
    whole = (F.col("text") == F.col("piece")) & (F.length("piece") <= D.OVERLAP + 1)
    seen = met.where(whole).select("text")
    rest = met.where(~whole).select("text", "word")
    if not rest.isEmpty():
        likely = shared.stored(words.join(D.few(rest), "word").select("k", "k2", F.col("text").alias("wanted")).distinct(), "likely")
        bodies = texts.select(F.xxhash64(body).alias("k"), F.xxhash64(F.lit(1), body).alias("k2"), body.alias("body"))
        seen = seen.union(bodies.join(D.few(likely), ["k", "k2"]).where(F.contains("body", "wanted")).select("wanted"))
    blank = asked.where("piece is null").select("text")
    n = blank.count()
    if n:
        blocks = blank.groupBy(F.pmod(F.xxhash64("text"), F.lit(n // CITED + 1)).alias("block")).agg(F.collect_list("text").alias("blanks")).select("blanks")
        blocks = F.broadcast(blocks) if n <= BROADCAST else blocks
        seen = seen.union(texts.select(body.alias("body")).crossJoin(blocks).select(F.explode(F.filter("blanks", lambda w: F.col("body").contains(w)))))
    marked = cited.withColumn("__low", F.lower(column)).join(seen.distinct().toDF("__low").withColumn("found", F.lit(True)), "__low", "left")
    return marked.withColumn("found", F.coalesce("found", F.lit(False))).drop("__low")


def verified(cited: DataFrame) -> DataFrame:
    """Counts of the cited texts that were found and of those that weren't."""
    return cited.agg(F.count_if("found").alias("real"), F.count_if(~F.col("found")).alias("fake"))


def first_seen(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return found.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def allowlist(chunks: DataFrame, key: str) -> DataFrame:
    """(key, allowed): distinct section ids of the chunks and of their texts."""
    own = F.when(F.col("section_id") != "", F.array(X.root_id(F.col("section_id")))).otherwise(F.array().cast("array<string>"))
    ids = F.concat(F.coalesce(own, F.array().cast("array<string>")), F.coalesce(X.section_ids(F.col("content")), F.array().cast("array<string>")))
    return chunks.select(key, F.explode(ids).alias("allowed")).distinct()


def guard(found: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Findings whose section isn't allowed on their sheet, nor a dotted prefix either way, lose section and citation."""
    per = allowed.groupBy(key).agg(F.collect_set("allowed").alias("__allowed"))
    root = X.root_id(F.col("section_id"))
    near = F.exists("__allowed", lambda a: (a == root) | a.startswith(F.concat(root, F.lit("."))) | root.startswith(F.concat(a, F.lit("."))))
    keep = F.coalesce(near, F.lit(False)) | (F.coalesce(F.col("section_id"), F.lit("")) == "")
    out = found.join(per, key, "left").withColumn("__keep", keep)
    for c in ("section_id", "code_citation"):
        out = out.withColumn("__" + c, F.when(F.col("__keep"), F.col(c)))
    return out.drop("section_id", "code_citation", "__keep", "__allowed").withColumnsRenamed({"__section_id": "section_id", "__code_citation": "code_citation"})


def format_chunks(section: Column, title: Column, content: Column) -> Column:
    body = F.substring(X.squeeze(F.coalesce(content, F.lit(""))), 1, 1200)
    return F.concat(F.lit("["), F.coalesce(section, F.lit("unknown")), F.lit("] "), F.coalesce(title, F.lit("")), F.lit("\n"), body)


def context(blocks: DataFrame, keys: DataFrame, key: str, order: list[str], block: str = "block") -> DataFrame:
    """(key, context): the blocks of each key in order, joined, or a line that says there are none."""
    own = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(block).alias("__block")))).alias("__all"))
    text = F.array_join(F.transform("__all", lambda x: x["__block"]), BETWEEN)
    return keys.join(own, key, "left").select(key, F.coalesce(text, F.lit(NONE_FOUND)).alias("context"))


def rule_draft(docs: DataFrame, key: str, text: str, block: int | None = None) -> DataFrame:
    """(key, pos, section, direction, value, unit, snippet): dimensional clauses with the last section named so far.

    block: clauses of a long document that one task reads.
    """
    long = (F.length(text) >= 2 * (block or S.SIZE)).alias("__many")  # a clause that another follows has a sign and white space
    clauses = docs.select(key, long, text).select(key, "__many", F.posexplode(F.split(text, r"(?<=[.;:])\s+|\n{2,}")).alias("pos", "clause"))
    named = F.try_element_at(X.section_ids(F.col("clause"), "9"), F.lit(-1))
    clauses = S.carried(clauses, key, "pos", F.col("__many"), {}, {"section": named}, block)
    measure = rf"(?i)(\d+(?:\.\d+)?)\s*(mm|m{X.END})"
    found = clauses.where(F.col("clause").rlike(r"(?i)not\s+less\s+than|not\s+more\s+than|at\s+least|minimum|maximum|min\.|max\.") & F.col("clause").rlike(measure))
    value = F.regexp_extract("clause", measure, 1).cast("double") * F.when(F.lower(F.regexp_extract("clause", measure, 2)) == "m", 1000).otherwise(1)
    return found.select(key, "pos", F.coalesce("section", F.lit("9.?")).alias("section"), X.direction(F.col("clause")).alias("direction"), value.alias("value"), F.lit("mm").alias("unit"), F.substring(X.squeeze(F.col("clause")), 1, 240).alias("snippet"))
