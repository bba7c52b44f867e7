"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

Contract. Words are runs of digits, letters a-z and characters beyond ASCII after lower-casing
A-Z. A window is `width` consecutive words of an item; an item with fewer words, but not none,
is one window. A document word inside any occurrence of a window is hit. An item is near in a document
that has, for one of its windows, every term at most `near` words away from an occurrence of the window's rarest
term, in any order; items with an occurring window are near.

Method. Term counts over the whole corpus rank the terms of each window. The index holds postings (document,
term, position). `phrases` intersects lists adjusted by the terms' offsets in the window, rarest
terms first: the two rarest lists of a window, stored for all documents, leave few candidates; the lists of all other
terms are stored for the candidates' documents alone, as no other posting can take part, and intersected
with them. `proximity` does the same with lists that meet within a distance.

Cases: null or wordless texts have no words and no hits; items without words never match; a
null item_id is not listed; rows equal in id and text share one result, rows that repeat an id
with another text don't mix; terms equally rare are taken in order of place; very long texts are exploded word
by word; empty tables give no hits. Only id and text columns are read, so others can't clash.

Scale. Three passes over the documents, the third over the candidates' texts only. Lists of terms and of candidates
are broadcast only when their counted size allows. Beyond that, words are dealt to SALT parts of a term by document and
position, so that a frequent term's list is no single task's, and texts are shuffled once to meet the candidates. Lists
are intersected by (document, position), which no frequent term can make hot.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _base as B

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LISTED = 1_000_000  # narrow rows that may be broadcast
SALT = 32
DOC = ("doc_id", "text_hash")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the cheap way where all characters are ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), CASED_GAP), "")).cast("long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, text): what the index reads of documents."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "left_semi", more=None) -> DataFrame:
    """left joined with right on equal columns, of which doc_id may be null on both sides."""
    a, b = left.alias("l"), right.alias("r")
    same = F.lit(True) if more is None else more
    for c in on:
        same = same & (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) if c == "doc_id" else F.col(f"l.{c}") == F.col(f"r.{c}"))
    return a.join(b, same, how)


def _of_terms(rows: DataFrame, listed: DataFrame, salt: Column) -> DataFrame:
    """rows joined with the listed ones of their term: a broadcast within its bound, else in SALT parts of each term."""
    n = listed.count()
    if n <= LISTED:
        return rows.join(F.broadcast(listed), "term")
    parts = listed.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("__part", F.pmod(salt, F.lit(SALT)).cast("int")).join(parts, ["term", "__part"]).drop("__part")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, term, pos) of the given terms (one column, distinct). docs: as keyed."""
    found = docs.select(*DOC, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return _of_terms(found, terms.toDF("term"), F.xxhash64(*DOC, "pos")).select(*DOC, "term", "pos")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) over all documents, 0 for terms that don't occur. docs: as keyed."""
    terms = terms.toDF("term")
    seen = docs.select(F.explode(words(F.col("text"))).alias("term"))
    if terms.count() <= LISTED:
        seen = seen.join(F.broadcast(terms), "term")
    seen = seen.groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


class Index:
    """The test items with their windows, term counts over the documents, and the posting lists that can take part."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int, near: int):
        """docs: as keyed; items: (item, iw) distinct sequences of words."""
        self.width, self.near = width, near
        places = items.select("item", "iw", F.posexplode("iw").alias("ipos", "term"))
        self.counts = B.store(term_counts(docs, places.select("term").distinct()), "terms")
        ranked = places.join(self.counts, "term")
        # each place offers itself to the windows it lies in; a window ranks its places, rarest first
        span = F.greatest(F.size("iw") - width, F.lit(0))
        wins = ranked.select("item", "ipos", "term", "n", F.explode(F.sequence(F.greatest(F.col("ipos") - width + 1, F.lit(0)), F.least(F.col("ipos"), span))).alias("win"))
        wins = wins.groupBy("item", "win").agg(F.array_sort(F.collect_list(F.struct("n", "ipos", "term"))).alias("by_place"))
        wins = wins.withColumn("terms", F.array_distinct(F.transform("by_place", lambda x: x["term"])))
        self.windows = B.store(wins.where("by_place[0].n > 0"), "windows")
        first, second = F.col("by_place")[0], F.get("by_place", F.lit(1))
        pairs = self.windows.select("item", "win", F.size("by_place").alias("need"), first["term"].alias("term"), first["ipos"].alias("a"), second["term"].alias("other"), second["ipos"].alias("b"))
        pairs = pairs.groupBy("item", "term", "a", "other", "b", "need").agg(F.min("win").alias("lo"), F.max("win").alias("hi"))
        span = F.slice("iw", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("need"))
        self.pairs = B.store(pairs.join(items, "item").withColumn("words", span).drop("iw", "hi"), "pairs")
        rare = self.pairs.select(F.explode(F.array("term", "other")).alias("term"))
        rare = rare.union(self.windows.select(F.explode(F.slice("terms", 1, 2)).alias("term")))
        #: postings of each window's two rarest terms, over all documents
        self.rare = B.store(postings(docs, rare.where("term is not null").distinct()), "postings")
        self.docs, self.rest = docs, None

    def store_rest(self, found: DataFrame) -> None:
        """Postings of all terms for the documents of found, the only ones in which the further lists can take part."""
        keys = B.store(found.select(*DOC).distinct(), "candidates")
        few = B.bounded_broadcast(keys, keys.count(), LISTED)
        self.rest = B.store(postings(_met(self.docs, few, [*DOC]), self.counts.where("n > 0").select("term")), "postings")


def phrase_candidates(index: Index) -> DataFrame:
    """(doc_id, text_hash, item, need, origin, first, last, lo, words): where the two rarest lists of a window agree."""
    one = _of_terms(index.rare, index.pairs, F.xxhash64(*DOC)).withColumn("origin", F.col("pos") - F.col("a"))
    two = one.where("b is not null").withColumn("pos", F.col("origin") + F.col("b")).withColumn("term", F.col("other"))
    met = one.where("b is null").union(_met(two, index.rare, [*DOC, "pos", "term"]).select(one.columns))
    ends = [F.least("a", F.coalesce("b", "a")), F.greatest("a", F.coalesce("b", "a"))]
    return met.select(*DOC, "item", "need", "origin", (F.col("origin") + ends[0]).alias("first"), (F.col("origin") + ends[1]).alias("last"), "lo", "words").distinct()


def phrases(index: Index, found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item, first, last): runs of document words that lie in occurring windows; found: phrase_candidates."""
    short = found.where("need <= 2").select(*DOC, "item", "first", "last")
    wanted = found.where("need > 2").select(*DOC, "item", "need", "origin", "lo", F.posexplode("words").alias("step", "term"))
    wanted = wanted.withColumn("pos", F.col("origin") + F.col("lo") + F.col("step")).select(*DOC, "item", "need", "origin", "pos", "term").distinct()
    met = _met(wanted, index.rest, [*DOC, "pos", "term"])
    along = W.partitionBy(*DOC, "item", "origin").orderBy("pos")
    runs = met.withColumn("island", F.col("pos") - F.row_number().over(along)).groupBy(*DOC, "item", "origin", "island")
    runs = runs.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("size"), F.max("need").alias("need"))
    return short.union(runs.where("size >= need").select(*DOC, "item", "first", "last"))


def _cells(df: DataFrame, within: int, spread: tuple[int, ...]) -> DataFrame:
    cell = F.floor(F.col("pos") / within)
    return df.withColumn("cell", F.explode(F.array(*[cell + d for d in spread])))


def _close(rows: DataFrame, index: DataFrame, within: int) -> DataFrame:
    """The rows (doc_id, text_hash, pos, term, ...) whose term is posted at most `within` words from pos."""
    near = F.abs(F.col("l.pos") - F.col("r.pos")) <= within
    return _met(_cells(rows, within, (-1, 0, 1)), _cells(index, within, (0,)), [*DOC, "term", "cell"], more=near).drop("cell").distinct()


def proximity_candidates(index: Index) -> DataFrame:
    """(doc_id, text_hash, item, pos, rarest, other): where the lists of a window's two rarest terms meet within the distance."""
    two = index.windows.select("item", F.col("terms")[0].alias("rarest"), F.get("terms", F.lit(1)).alias("other")).distinct()
    one = _of_terms(index.rare, two.withColumn("term", F.col("rarest")), F.xxhash64(*DOC)).drop("term")
    met = _close(one.where("other is not null").withColumn("term", F.col("other")), index.rare, index.near).select(one.columns)
    return one.where("other is null").union(met).select(*DOC, "item", "pos", "rarest", "other").distinct()


def proximity(index: Index, found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item) of the items near in a document; found: proximity_candidates."""
    more = F.slice("terms", 3, index.width)
    windows = index.windows.select("item", F.col("terms")[0].alias("rarest"), F.get("terms", F.lit(1)).alias("other"), F.array_sort(more).alias("more")).distinct()
    windows = windows.withColumn("window", F.xxhash64("rarest", "other", "more"))
    a, b = found.alias("l"), windows.alias("r")
    same = (F.col("l.item") == F.col("r.item")) & (F.col("l.rarest") == F.col("r.rarest")) & F.col("l.other").eqNullSafe(F.col("r.other"))
    met = a.join(b, same).select(*DOC, "l.item", "pos", "window", "more")
    wanted = met.where(F.size("more") > 0).withColumn("n", F.size("more")).withColumn("term", F.explode("more")).drop("more")
    close = _close(wanted, index.rest, index.near).groupBy(*DOC, "item", "window", "pos").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    return met.where(F.size("more") == 0).select(*DOC, "item").union(close.where("k = n").select(*DOC, "item")).distinct()


def _items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item_id, item, iw) of the items with words; item: their words' hash."""
    test = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(item_text)).alias("iw")).where(F.size("iw") > 0)
    return B.store(test.withColumn("item", F.xxhash64("iw")), "items")


def hits(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, first, last): runs of document words that lie in windows of the item."""
    test = _items(items, item_id, item_text)
    index = Index(keyed(docs, id_col, text_col), test.select("item", "iw").distinct(), width, 2 * width)
    found = B.store(phrase_candidates(index), "phrases")
    index.store_rest(found.where("need > 2"))
    return phrases(index, found).join(test.select("item", "item_id"), "item")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, near: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, n_words, n_hit, items, near), one for each row of docs; items: sorted ids as strings of the
    items with occurring windows, near: of those near in the document (distance by default 2 * width)."""
    test = _items(items, item_id, item_text)
    index = Index(keyed(docs, id_col, text_col), test.select("item", "iw").distinct(), width, near or 2 * width)
    exact, close = B.store(phrase_candidates(index), "phrases"), B.store(proximity_candidates(index), "near")
    index.store_rest(exact.where("need > 2").select(*DOC).union(close.select(*DOC)))
    runs = B.store(phrases(index, exact), "runs")
    sure = runs.select(*DOC, "item").distinct()
    close = sure.union(proximity(index, _met(close, sure, [*DOC, "item"], "left_anti")))
    spans = F.array_sort(F.collect_set(F.struct("first", "last")))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).cast("long").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        new = F.greatest(x["last"] - F.greatest(x["first"] - 1, acc["end"]), F.lit(0))
        return F.struct((acc["total"] + new).cast("long").alias("total"), F.greatest(acc["end"], x["last"]).cast("long").alias("end"))

    ids = test.select("item", "item_id")
    spans = runs.groupBy(*DOC).agg(F.aggregate(spans, start, step, lambda a: a["total"]).alias("n_hit"))
    listed = sure.join(ids, "item").groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    nearby = close.join(ids, "item").groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("near"))
    per = _met(_met(nearby, spans, [*DOC], "left").select("l.*", "n_hit"), listed, [*DOC], "left").select("l.*", "items")
    per = B.store(per, "hits").select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), "n_hit", "items", "near")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), n_words(F.col(text_col)).alias("n_words"))
    out = rows.join(per, rows["doc_id"].eqNullSafe(per["h_id"]) & (rows["text_hash"] == per["h_hash"]), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS w, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT w FROM bw),
dw AS (SELECT doc_id, w, i, array_to_string(ws[i:i + w - 1], ' ') AS win
       FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, lens WHERE len(ws) >= w)),
m AS (SELECT dw.doc_id, bw.item_id, dw.i, dw.w FROM dw JOIN bw ON dw.win = bw.win AND dw.w = bw.w),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM d),
bp AS (SELECT item_id, unnest(ws) AS term, unnest(range(len(ws))) AS ipos, len(ws) AS size FROM b WHERE len(ws) > 0),
tc AS (SELECT DISTINCT bp.term, coalesce(n, 0) AS n FROM bp LEFT JOIN (SELECT term, count(*) AS n FROM dp GROUP BY term) x ON bp.term = x.term),
wt AS (SELECT item_id, win, bp.term, n, min(ipos) AS ipos FROM (SELECT *, unnest(range(greatest(ipos - 9, 0), least(ipos, greatest(size - 10, 0)) + 1)) AS win FROM bp) bp JOIN tc ON bp.term = tc.term GROUP BY item_id, win, bp.term, n),
wr AS (SELECT item_id, win, first(term ORDER BY n, ipos) AS rarest, list_sort(list(term)) AS terms FROM wt GROUP BY item_id, win HAVING min(n) > 0),
ws AS (SELECT DISTINCT item_id, rarest, terms FROM wr),
wx AS (SELECT *, unnest(terms) AS term, len(terms) AS n FROM ws),
nr AS (SELECT DISTINCT doc_id, item_id FROM (
         SELECT x.doc_id, item_id, terms, x.pos, max(n) AS n, count(DISTINCT y.term) AS k FROM wx JOIN dp x ON x.term = wx.rarest JOIN dp y ON y.doc_id = x.doc_id AND y.term = wx.term AND abs(y.pos - x.pos) <= 20 GROUP BY x.doc_id, item_id, rarest, terms, x.pos) WHERE n = k),
nn AS (SELECT doc_id, count(*) AS n_near FROM nr GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(nn.n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN nn ON d.doc_id = nn.doc_id
"""
