"""Ranked lexical search over document shards of integer impacts.

Contract. Terms are the longest runs of ASCII letters, digits and any other than ASCII signs, with A-Z lower-cased. With N
documents that have a term, L terms in all, n in a document, df documents that hold a term and tf times in one of them, a term
weighs w = floor(1000 * ln((2N + 2) / (2df + 1))) and has the impact (10^9 tf) div (1000 tf + 12 m) in a document, where
m = 75 + (25 n N) div L. A document's score is the sum of w * impact over a query's terms, repeats included; the `count` best
above 0 come back, equal scores by ascending id.

Cases: ids are whole numbers, what can't be read as one raises an error; null and termless texts match nothing and don't count in N; rows that repeat a document's id are documents of their own;
rows that repeat a query's id, null too, are one query with all their terms; a null document id comes after all others; an
empty table, of documents or queries, gives an empty result; only ids and texts are read, so other columns can't clash.

Index. A first pass counts N and L. A second makes shards of about SHARD bytes of text, each in one task: the terms, and for each its
documents and their impacts as flat arrays (CSR). Documents are in the order of their ids, so equal scores need no
further look. A term of all documents is a list in every shard, never one list. The number of documents of a term is the sum
of its lists' lengths, summed in each task first.

Search. Queries go in blocks past the shards: up to QUERIES of them are broadcast, more are a product of blocks. A query's lists
are added term by term to a dense array of the shard's documents, the best are taken by partition with ties
settled by place, and a task keeps the best of all its shards, so that only those reach the last ranking.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _base as B

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD, SHARD_ROWS = 16 << 20, 1 << 16
#: queries of a block, queries whose blocks may be broadcast, and matches that a task holds
BLOCK, QUERIES, HELD = 512, 20_000, 1 << 18
SHARDS = "ids array<long>, terms array<string>, sizes array<int>, docs binary, impacts binary"


class Index(NamedTuple):
    """Shards of postings, and the documents and terms they hold."""

    shards: DataFrame
    documents: int
    terms: int


def _terms(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a string column and the row of each."""
    lists = pc.split_pattern_regex(pc.ascii_lower(col.fill_null("")), GAP)
    flat, rows = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(False))
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), rows[some.to_numpy(False)]


def _gap_table() -> np.ndarray:
    gap = np.zeros(256, bool)
    gap[:128] = True
    gap[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
    return gap


def _count(batches):
    """(documents, terms) of each batch."""
    gap = _gap_table()
    for batch in batches:
        docs = terms = 0
        b, offs = B.text_buffers(batch.column(0))
        for lo, hi in B.row_blocks(offs, 4 * B.PIECE):
            word = ~gap[b[offs[lo] : offs[hi]]]
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            at = offs[lo : hi + 1] - offs[lo]
            first = at[:-1][np.diff(at) > 0]
            begins[first] = word[first]
            own = np.diff(np.concatenate([[0], np.cumsum(begins)])[at])
            docs, terms = docs + int((own > 0).sum()), terms + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])


def _shards(documents: int, terms: int, limit: int, most: int):
    """CSR postings of runs of rows."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("impacts", pa.binary())])

    def shard(parts):
        table = pa.Table.from_batches(parts)
        ids, text = (table.column(i).combine_chunks() for i in (0, 1))
        order = pc.array_sort_indices(ids, null_placement="at_end")
        place = np.empty(len(ids), np.int64)
        place[order.to_numpy(False)] = np.arange(len(ids))
        found, rows = _terms(text)
        if not len(found):
            return None
        codes = found.dictionary_encode()
        pairs, tf = np.unique(codes.indices.to_numpy(False).astype(np.int64) * len(ids) + place[rows], return_counts=True)
        term, doc = np.divmod(pairs, len(ids))
        n = np.bincount(place[rows], minlength=len(ids)).astype(np.int64)
        m = 75 + 25 * n * documents // terms
        impacts = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        sizes = np.bincount(term, minlength=len(codes.dictionary)).astype(np.int32)
        row = [ids.take(order), codes.dictionary, pa.array(sizes), doc.astype(np.int32).tobytes(), impacts.astype(np.int32).tobytes()]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row[:3]]
        return pa.RecordBatch.from_arrays([*lists, pa.array([row[3]], pa.binary()), pa.array([row[4]], pa.binary())], schema=schema)

    def run(batches):
        held, size, rows = [], 0, 0
        for batch in batches:
            _, offs = B.text_buffers(batch.column(1))
            for lo, hi in B.row_blocks(offs, limit):
                for at in range(lo, hi, most):
                    to = min(at + most, hi)
                    more, own = int(offs[to] - offs[at]), to - at
                    if held and (size + more > limit or rows + own > most):
                        if (made := shard(held)) is not None:
                            yield made
                        held, size, rows = [], 0, 0
                    held, size, rows = [*held, batch.slice(at, own)], size + more, rows + own
        if held and (made := shard(held)) is not None:
            yield made

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, rows: int = SHARD_ROWS) -> Index:
    """The stored index of all documents; shard and rows bound the bytes of text and the documents of a shard."""
    spark = B.session(docs)
    B.ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text") != "")
    documents, terms = src.select("text").mapInArrow(B.lean(_count), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    made = src.mapInArrow(B.lean(_shards(documents or 0, max(terms or 0, 1), shard, rows)), SHARDS)
    return Index(B.store(made, "shards", "zstd"), documents or 0, terms or 0)


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, times) of each query."""
    low = F.translate(F.col(text_col), UPPER, LOWER)
    rows = queries.select(F.col(id_col).cast("long").alias("item"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    return rows.groupBy("item", "term").agg(F.count("*").alias("times"))


def _ranked(count: int, held_rows: int):
    """Over pairs of a shard and a block of queries: the best documents of each query among all that the task has met."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def best(scores):
        """Places of the `count` highest scores above 0, the lowest places of equal ones."""
        at = np.flatnonzero(scores > 0)
        if len(at) <= count:
            return at
        own = scores[at]
        cut = np.partition(own, len(own) - count)[len(own) - count]
        above = at[own > cut]
        return np.concatenate([above, at[own == cut][: count - len(above)]])

    def matched(batch, i):
        """Found rows of one pair."""
        ids, names = (batch.column(c)[i].values for c in (0, 1))
        starts = np.concatenate([[0], np.cumsum(batch.column(2)[i].values.to_numpy(False), dtype=np.int64)])
        docs, impacts = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in (3, 4))
        entries = batch.column(5)[i].values
        item, term, weight = (entries.field(k) for k in range(3))
        at = pc.index_in(term, value_set=names)
        some = at.is_valid()
        keys = item.filter(some).dictionary_encode(null_encoding="encode")
        at, weight, item = at.filter(some).to_numpy(False), weight.filter(some).to_numpy(False), keys.indices.to_numpy(False)
        order = np.argsort(item, kind="stable")
        at, weight, item = at[order], weight[order], item[order]
        borders = np.searchsorted(item, np.arange(len(keys.dictionary) + 1))
        which, where, score = [], [], []
        for k, (lo, hi) in enumerate(zip(borders, borders[1:])):
            total = np.zeros(len(ids), np.int64)
            for t, w in zip(at[lo:hi].tolist(), weight[lo:hi].tolist()):
                a, z = starts[t], starts[t + 1]
                total[docs[a:z]] += w * impacts[a:z].astype(np.int64)
            found = best(total)
            which.append(np.full(len(found), k))
            where.append(found)
            score.append(total[found])
        if not which:
            return None
        cols = [keys.dictionary.take(pa.array(np.concatenate(which))), ids.take(pa.array(np.concatenate(where))), pa.array(np.concatenate(score))]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def reduced(parts):
        table = pa.Table.from_batches(parts, schema).combine_chunks()
        item = pc.dictionary_encode(table.column(0), null_encoding="encode").combine_chunks().indices.to_numpy(False)
        place = pc.rank(table.column(1), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(False)
        order = np.lexsort((place, -table.column(2).to_numpy(), item))
        own = item[order]
        return table.take(pa.array(order[np.arange(len(own)) - np.searchsorted(own, own) < count])).combine_chunks().to_batches()

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                if (found := matched(batch, i)) is None:
                    continue
                held.append(found)
                n += found.num_rows
                if n > held_rows:
                    held = reduced(held)
                    n = sum(x.num_rows for x in held)
                    if 2 * n > held_rows:
                        yield from held
                        held, n = [], 0
        if n:
            yield from reduced(held)

    return run


def search(index: Index, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", count: int = 20, block: int = BLOCK, few: int = QUERIES, held: int = HELD) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each query.

    block: queries in a block; few: queries whose blocks may be broadcast; held: matches that a task holds before it passes them on.
    """
    asked = B.store(query_terms(queries, id_col, text_col), "asked")
    words = asked.select("term").distinct()
    lists = index.shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.sizes").alias("size"))
    known = lists.join(B.bounded_broadcast(words, words.count()), "term").groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * index.documents + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(known, "term").select("item", "term", (weight * F.col("times")).alias("w")).where("w > 0")
    items = asked.select("item").distinct().count()
    blocks = weighed.groupBy(F.pmod(F.xxhash64("item"), F.lit(-(-items // block) or 1)).alias("block")).agg(F.collect_list(F.struct("item", "term", "w")).alias("asked")).select("asked")
    blocks = B.store(blocks, "blocks")
    met = index.shards.crossJoin(F.broadcast(blocks) if items <= few else blocks)
    best = met.mapInArrow(B.lean(_ranked(count, held)), "item_id long, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT rid, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0), t AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM s),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(t.nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, t GROUP BY term),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
r AS (SELECT q.item_id, p.rid, sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * s.n * t.nn) // t.ll))))::BIGINT AS score
      FROM q JOIN p ON q.term = p.term JOIN w ON w.term = q.term JOIN s ON s.rid = p.rid, t GROUP BY q.item_id, p.rid),
k AS (SELECT r.item_id, row_number() OVER (PARTITION BY r.item_id ORDER BY r.score DESC, s.doc_id NULLS LAST)::INTEGER AS rank, s.doc_id, r.score FROM r JOIN s ON s.rid = r.rid WHERE r.score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
