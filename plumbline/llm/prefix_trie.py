"""Prefix trie of conversations: succinct level-order tries of prefix shards, heavy upper levels merged apart.

Contract. The turns of a conversation are ordered by turn, null first; null role or text is empty. Conversation c is rebuilt
as the first h turns of conversation c - c % 20 (as many as it has) and its own turns after the first h, h being the CRC-32 of
c's digits modulo 4. Every distinct sequence of first d rebuilt turns is a node of depth d; its members are the rebuilt
conversations that begin with it, those without any turn too.

Cases: turns with equal numbers are ordered by role and text; rows without a conv_id belong to no conversation and are left
out; null and empty texts are one text of no words; equal conversations are members of all the same nodes; an empty
table has no conversation and gives no row, not even the root; only conv_id, turn, role and text are read, so other columns
can't clash.

Numbers along a conversation (places, prefix hashes) are prefix scans over ranges of rows sorted by conversation and place; a
conversation that spans several ranges is stitched by their totals, so one with a third of all rows is many tasks. A prefix is
known by two 64-bit hashes. Equal rebuilt conversations are counted once and stand for their number; the ids of
those that end in one node are joined in packs of PACK ids, which stream past one digest.

Tries. Nodes with more than `limit` turns at or below them are upper nodes; every other node whose parent is one, or the root, is
the top of a subtree, which has at most `limit` rows. Subtrees are dealt to shards; each becomes a trie in level order:
LOUDS bits (a node's children as ones, then a zero), and flat arrays of labels, words, members and smallest members.
Sums over subtrees go up level by level. Upper nodes, the few that many conversations share, take the sums of the
tops below them in one aggregation. An upper node of a single conversation is a long private tail; its sums are known without its trie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _base as B

LIMIT, PACK_BITS = 1 << 14, 12
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
TRIE = "shard long, levels array<long>, tops array<long>, louds binary, label1 binary, label2 binary, words binary, members binary, convs binary, ends array<string>"
NOTHING = hashlib.sha256(b"").hexdigest()


# --- prefix scans ---------------------------------------------------------------------------


def _scanned(columns: list[str]):
    """Over rows sorted by conversation: the part, and within it the place, the xor of v1 and of v2, and the sum of words so far."""
    conv, v1, v2, words = (columns.index(c) for c in ("conv", "v1", "v2", "words"))
    names = [*columns, "part", "pos", "x1", "x2", "sum"]

    def run(batches):
        part, last, carried = TaskContext.get().partitionId(), None, [0, 0, 0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(conv).to_numpy()
            begins = np.append(True, own[1:] != own[:-1])
            first = np.flatnonzero(begins)
            of = np.cumsum(begins) - 1
            if last is None or own[0] != last:
                carried = [0, 0, 0, 0]
            out = [np.arange(1, len(own) + 1) - first[of]]
            for c in (v1, v2):
                total = np.append(0, np.bitwise_xor.accumulate(batch.column(c).to_numpy()))
                out.append(total[1:] ^ total[first][of])
            total = np.append(0, np.cumsum(batch.column(words).to_numpy()))
            out.append(total[1:] - total[first][of])
            head = of == 0
            out[0][head] += carried[0]
            out[3][head] += carried[3]
            for c in (1, 2):
                out[c][head] ^= carried[c]
            last, carried = own[-1], [int(x[-1]) for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part)), *[pa.array(x.astype(np.int64)) for x in out]], names)

    return run


def scan(rows: DataFrame, by: list[str], order: list[str], keep: list, what: str) -> DataFrame:
    """Stored rows (keep, pos, x1, x2, sum): prefix scans of each conversation in the order given.

    rows are dealt to ranges of `by`; a conversation that spans ranges gets the totals of those before.
    """
    spark = B.session(rows)
    narrow = rows.repartitionByRange(*by).sortWithinPartitions(*order).select(*keep)
    schema = T.StructType([*narrow.schema.fields, *[T.StructField(n, T.LongType()) for n in ("part", "pos", "x1", "x2", "sum")]])
    made = B.store(narrow.mapInArrow(_scanned(narrow.columns), schema), what)
    edges = made.groupBy("part").agg(F.array_distinct(F.array(F.min("conv"), F.max("conv"))).alias("c")).select("part", F.explode("c").alias("conv"))
    # two rows a part at most
    totals = made.join(F.broadcast(edges), ["part", "conv"]).groupBy("conv", "part").agg(*[F.max_by(c, "pos").alias(c) for c in ("pos", "x1", "x2", "sum")])
    order = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = [F.sum(c).over(order).alias("b_" + c) for c in ("pos", "sum")] + [F.bit_xor(c).over(order).alias("b_" + c) for c in ("x1", "x2")]
    over = B.store(totals.select("conv", "part", *before).where("b_pos is not null"), what)
    out = made.join(F.broadcast(over), ["conv", "part"], "left")
    zero = {c: F.coalesce("b_" + c, F.lit(0)) for c in ("pos", "x1", "x2", "sum")}
    return out.withColumns({**{c: F.col(c) + zero[c] for c in ("pos", "sum")}, **{c: F.col(c).bitwiseXOR(zero[c]) for c in ("x1", "x2")}}).drop("part", *["b_" + c for c in zero])


# --- rebuilt conversations --------------------------------------------------------------------


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, size) of all rebuilt conversations, and their turns (conv, d, h1, h2, words)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text")).where("conv is not null")
    hashes = [F.xxhash64("role", "text").alias("v1"), F.xxhash64(F.lit(1), "role", "text").alias("v2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")]
    turns = scan(rows, ["conv", "turn"], ["conv", "turn", "role", "text"], ["conv", *hashes], "turns").select("conv", "pos", F.col("v1").alias("h1"), F.col("v2").alias("h2"), "words")
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    known = sizes.select("conv", "n", head.alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    known = known.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    borrowed = F.least("h", F.coalesce("base_n", F.lit(0)))
    known = B.store(known.select("conv", "base", "h", borrowed.alias("hb"), (borrowed + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "convs")
    own = turns.join(known, "conv").where("pos > h").select("conv", (F.col("hb") + F.col("pos") - F.col("h")).alias("d"), "h1", "h2", "words")
    firsts = turns.where("pos <= 3 and conv % 20 = 0").select(F.col("conv").alias("base"), F.col("pos").alias("d"), "h1", "h2", "words")
    heads = firsts.join(known, "base").where("d <= hb").select("conv", "d", "h1", "h2", "words")
    return known.select("conv", "size"), own.union(heads)


def _digested(batches):
    """SHA-256 of the packs of each node, which follow each other in order."""
    at, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in at], pa.array([digest.hexdigest()])], ["e1", "e2", "size", "ends"])

    for batch in batches:
        for *key, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if key != at:
                if at:
                    yield row()
                at, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if at:
        yield row()


def terminals(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(rep, times, size, ends): one row for all equal conversations, their smallest id, number, turns, and digest of ids."""
    v = [F.xxhash64("d", "h1", "h2").alias("v1"), F.xxhash64("h2", "h1", "d").alias("v2")]
    last = turns.select("conv", *v).groupBy("conv").agg(F.bit_xor("v1").alias("e1"), F.bit_xor("v2").alias("e2"))
    zero = F.lit(0).cast("long")
    each = B.store(convs.join(last, "conv", "left").select("conv", "size", F.coalesce("e1", zero).alias("e1"), F.coalesce("e2", zero).alias("e2")), "each")
    key = ["e1", "e2", "size"]
    packs = each.groupBy(*key, F.shiftright("conv", PACK_BITS).alias("pack")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    ends = packs.repartition(*key).sortWithinPartitions(*key, "pack").select(*key, "ids").mapInArrow(_digested, "e1 long, e2 long, size long, ends string")
    return B.store(each.groupBy(*key).agg(F.min("conv").alias("rep"), F.count("*").alias("times")).join(ends, key).select("rep", "times", "size", "ends"), "terminals")


# --- succinct tries -----------------------------------------------------------------------------


def _build(table: pa.Table) -> pa.Table:
    """One shard's trie in level order. Rows: shard, rep, d, top (depth of its subtree's top), x1, x2, h1, h2, words, times, ends."""
    col = {c: table.column(c).to_numpy() for c in ("rep", "d", "top", "x1", "x2", "h1", "h2", "words", "times")}
    level = col["d"] - col["top"]
    order = np.lexsort((col["rep"], level))
    borders = np.searchsorted(level[order], np.arange(int(level.max()) + 2))
    _, rep = np.unique(col["rep"], return_inverse=True)
    at = np.full(int(rep.max()) + 1, -1)  # the node that each conversation is in
    first, parents, end, members, convs = [], [], [], [], []
    n = 0
    for lo, hi in zip(borders, borders[1:]):
        rows = order[lo:hi]
        up = at[rep[rows]]
        names = ("x1", "x2") if n == 0 else ("h1", "h2")
        rows = rows[np.lexsort((col[names[1]][rows], col[names[0]][rows], up))]
        up = at[rep[rows]]
        new = np.append(True, (up[1:] != up[:-1]) | (col[names[0]][rows][1:] != col[names[0]][rows][:-1]) | (col[names[1]][rows][1:] != col[names[1]][rows][:-1]))
        begin = np.flatnonzero(new)
        at[rep[rows]] = n + np.cumsum(new) - 1
        first.append(rows[begin])
        parents.append(up[begin])
        members.append(np.add.reduceat(col["times"][rows], begin))
        convs.append(np.minimum.reduceat(col["rep"][rows], begin))
        end.append((rows, at[rep[rows]]))
        n += len(begin)
    node, parent = np.concatenate(first), np.concatenate(parents)
    zeros = np.cumsum(np.bincount(parent + 1, minlength=n + 1) + 1) - 1  # the super-root's children, then each node's
    bits = np.ones(2 * n + 1, bool)
    bits[zeros] = False
    ends: list[str | None] = [None] * n
    own = table.column("ends").to_pylist()
    for rows, nodes in end:
        for r, k in zip(rows.tolist(), nodes.tolist()):
            if own[r] is not None:
                ends[k] = own[r]
    flat = [np.packbits(bits), col["h1"][node], col["h2"][node], col["words"][node], np.concatenate(members), np.concatenate(convs)]
    tops = col["top"][first[0]]
    arrays = [pa.array([[len(x) for x in first]], pa.list_(pa.int64())), pa.array([tops.tolist()], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in flat], pa.array([ends], pa.list_(pa.string()))]
    return pa.Table.from_arrays([table.column("shard")[:1], *arrays], [f.split()[0] for f in TRIE.split(", ")])


def parents_of(louds: bytes, n: int) -> np.ndarray:
    """The parent of each node of a trie with n nodes, -1 of tops: the zeros before a node's one, less the super-root's."""
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(louds, np.uint8), count=2 * n + 1))
    return ones - np.arange(n) - 1


def _rolled(batches):
    """Rows of nodes with the sums over their subtrees, which go up level by level."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes, tops = row["levels"], np.array(row["tops"])
            n = sum(sizes)
            words, members, convs = (np.frombuffer(row[c], np.int64) for c in ("words", "members", "convs"))
            parent = parents_of(row["louds"], n)
            children = np.bincount(parent + 1, minlength=n + 1)[1:]
            leaves, saved, depth = (children == 0).astype(np.int64), (members - 1) * words, np.zeros(n, np.int64)
            depth[: len(tops)] = tops
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for lo, hi in zip(starts[1:-1], starts[2:]):
                depth[lo:hi] = depth[parent[lo:hi]] + 1
            for lo, hi in list(zip(starts[1:-1], starts[2:]))[::-1]:
                np.add.at(leaves, parent[lo:hi], leaves[lo:hi])
                np.add.at(saved, parent[lo:hi], saved[lo:hi])
            top = parent < 0
            cols = [convs, depth, np.where(top, 0, convs[np.maximum(parent, 0)]), members, children, leaves, saved]
            arrays = [pa.array(x, mask=top if k == 2 else None) for k, x in enumerate(cols)]
            ends = pa.array([x or NOTHING for x in row["ends"]])
            yield pa.RecordBatch.from_arrays([*arrays, ends], [f.split()[0] for f in NODE.split(", ")])


def tries(rows: DataFrame, limit: int) -> DataFrame:
    """The stored tries of all shards. rows: rep, d, top, key, and what _build takes."""
    shards = rows.count() * 2 // limit + 1
    dealt = rows.withColumn("shard", F.pmod("key", F.lit(shards).cast("long"))).select("shard", "rep", "d", "top", "x1", "x2", "h1", "h2", "words", "times", "ends")
    return B.store(dealt.groupBy("shard").applyInArrow(B.lean_group(_build), TRIE), "tries")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    limit: turns at or below a node from which it is merged apart from its shard.
    """
    spark = B.session(conversations)
    B.ship(spark)
    convs, turns = rebuilt(conversations)
    known = terminals(convs, turns)
    n, least = known.agg(F.sum("times"), F.min("rep")).first()
    if not n:
        return spark.createDataFrame([], NODE)
    once = turns.join(known, F.col("conv") == F.col("rep")).drop("rep")
    kept = ["conv", "d", "h1", "h2", "words", "times", "size", F.when(F.col("d") == F.col("size"), F.col("ends")).alias("ends"), F.xxhash64("d", "h1", "h2").alias("v1"), F.xxhash64("h2", "h1", "d").alias("v2")]
    path = B.store(scan(once, ["conv", "d"], ["conv", "d"], kept, "path").withColumnRenamed("conv", "rep").drop("v1", "v2", "pos"), "path")

    # upper nodes, and where each conversation leaves them
    node = ["x1", "x2", "d"]
    below = F.sum(F.col("size") - F.col("d") + 1).alias("below")
    upper = path.groupBy(*node).agg(below, F.count("*").alias("kinds"), F.min("rep").alias("conv"), F.sum("times").alias("members"), F.max("words").alias("words"), F.max("ends").alias("ends")).where(F.col("below") > limit)
    upper = B.store(upper, "upper")
    along = path.select("rep", *node, "size", "sum", "words").join(upper.select(*node, "conv", F.col("kinds") > 1, "members").toDF(*node, "conv", "heavy", "members"), node)
    along = B.store(along, "along")
    tops = along.groupBy("rep").agg((F.max("d") + 1).alias("top"), F.max(F.when(F.col("heavy"), F.col("d"))).alias("shared"))
    tops = path.join(tops, "rep", "left").withColumn("top", F.coalesce("top", F.lit(1).cast("long"))).where("d = top").select("rep", "top", F.col("x1").alias("key"))
    rows = path.join(tops, "rep").where("d >= top").select("rep", "d", "top", "key", "x1", "x2", "h1", "h2", "words", "times", "ends")
    nodes = B.store(tries(B.store(rows, "rows"), limit).mapInArrow(_rolled, NODE), "nodes")

    # what upper nodes and the root get from the tops below them
    above = along.select("rep", (F.col("d") + 1).alias("depth"), F.col("conv").alias("up"), F.col("heavy").alias("up_heavy"))

    def placed(items: DataFrame) -> DataFrame:
        """items (conv, depth, ...) with the smallest member of their parent, and whether that is the root or shared."""
        met = items.join(above.withColumnRenamed("rep", "conv"), ["conv", "depth"], "left")
        return met.withColumns({"up": F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("up")), "up_heavy": F.coalesce("up_heavy", F.lit(True))})

    total = path.where("d = size").select(F.col("rep").alias("conv"), F.col("sum").alias("all"))
    heavy = placed(upper.where("kinds > 1").select("conv", F.col("d").alias("depth"), *node[:2], "members", ((F.col("members") - 1) * F.col("words")).alias("own"), "ends"))
    tails = along.where("not heavy").select("conv", F.col("d").alias("depth"), "members", F.col("sum"), "words").join(total, "conv")
    tails = placed(tails.withColumn("saved", (F.col("members") - 1) * (F.col("all") - F.col("sum") + F.col("words"))))
    first = placed(nodes.where("parent_conv_id is null").withColumnRenamed("conv_id", "conv"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    given = first.where("up_heavy").select("conv", "depth", "n_leaves", F.col("saved_tokens").alias("saved"))
    given = given.union(tails.where("up_heavy").select("conv", "depth", one, "saved")).union(heavy.select("conv", "depth", zero, F.col("own")))
    given = B.store(given, "given")
    sums = [F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")]
    taken = given.withColumnRenamed("conv", "rep").join(along.where("heavy").select("rep", *node), "rep").where("d < depth")
    taken = taken.groupBy(*node).agg(F.count_if(F.col("d") == F.col("depth") - 1).alias("n_children"), *sums).withColumnRenamed("d", "depth")
    shared = heavy.join(taken, ["x1", "x2", "depth"]).select("conv", "depth", "up", "members", "n_children", "n_leaves", (F.col("saved") + F.col("own")).alias("saved"), F.coalesce("ends", F.lit(NOTHING)))
    private = tails.select("conv", "depth", "up", "members", one, one, "saved", F.lit(NOTHING))
    under = nodes.where("parent_conv_id is not null").union(first.select("conv", "depth", "up", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    bare = known.where("size = 0").agg(F.max("ends").alias("ends"))
    root = given.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.coalesce(F.sum("n_leaves"), one).alias("n_leaves"), F.coalesce(F.sum("saved"), zero).alias("saved")).crossJoin(bare)
    root = root.select(F.lit(least).cast("long"), zero, F.lit(None).cast("long"), F.lit(n).cast("long"), "n_children", "n_leaves", "saved", F.coalesce("ends", F.lit(NOTHING)))
    return root.union(under).union(shared).union(private).toDF(*[f.split()[0] for f in NODE.split(", ")])


SQL = r"""
WITH RECURSIVE tab(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tab WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
o AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce("text", '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hs AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(o.c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, crc.t[(xor(a & 255, b)) + 1])), 4294967295) % 4 AS h FROM o, crc),
m AS (SELECT a.c, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS s FROM hs a LEFT JOIN o b ON b.c = a.c - a.c % 20),
x AS (SELECT c, s, len(s) AS n, unnest(range(0, len(s) + 1)) AS d FROM m),
p AS (SELECT d, s[1:d] AS q, min(c) AS conv_id, count(*) AS members, sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM x GROUP BY d, s[1:d]),
k AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (members - 1) * len(regexp_extract_all(q[d].t, '[^\x20\x09-\x0D]+')) END AS own FROM p),
ch AS (SELECT a.d, a.q, count(b.d) AS children, any_value(a.own) AS own FROM k a LEFT JOIN k b ON b.d = a.d + 1 AND b.q[1:a.d] = a.q GROUP BY a.d, a.q),
sub AS (SELECT q[1:j] AS q, j AS d, sum((children = 0)::BIGINT) AS leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM ch) GROUP BY q[1:j], j)
SELECT k.conv_id, k.d::BIGINT AS depth, u.conv_id AS parent_conv_id, k.members::BIGINT AS n_convs, ch.children::BIGINT AS n_children, sub.leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, k.ends AS ends_sha256
FROM k JOIN ch ON ch.d = k.d AND ch.q = k.q JOIN sub ON sub.d = k.d AND sub.q = k.q LEFT JOIN k u ON u.d = k.d - 1 AND u.q = k.q[1:k.d - 1]
"""
