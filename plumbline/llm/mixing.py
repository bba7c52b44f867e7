"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Contract. A document's size is its number of words (runs between ASCII white space; null: 0).
Sources in code point order, null last, take the weights in turn, repeating, and share
`share` times all sizes; no target exceeds `most` times its source's size, the excess is
reshared by weight. A source first takes all its documents floor(target / size) times; the
rest is filled in the order of exponential keys -ln(u) / quality, u a hash of the id: those
whose prefix sum stays within the rest, then the one remaining document that brings the sum
closest to it, if that is closer.

Cases: null or empty texts have size 0 and take 0; a source without words has target 0; rows
that repeat an id share a key and are ordered by size; null ids and null qualities are defined
(hash of the empty string; quality 1); an empty table gives an empty result. All internal
columns live in a table of their own, so other columns can't clash.

Scale. Words are counted once into a narrow stored table. Prefix sums run in two levels: rows are dealt to ranges of
(source, key) of about RANGE rows by sampled bounds, whatever the weights, sums run over the ranges and within each, so
no task sorts a whole source however large. Sources are ranked and summed the same way, however many. The table of
sources is broadcast by Spark only where its stored size is within the session's limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _base as B

GAP = r"[\x20\x09-\x0D]+"
HASH_SPAN = float(1 << 52)
RANGE = 200_000  # rows in one sorted range


def words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")).cast("long")


def uniform(key: Column) -> Column:
    """A repeatable number in (0, 1) from 52 bits of the id's MD5."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / HASH_SPAN


def ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df with `part`: the place of a row's range in this order; a range holds about RANGE rows, and several are stored."""
    parts = df.count() // RANGE + 1
    if parts == 1:
        return df.withColumn("part", F.lit(0))
    return B.store(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """df with, for each value, the sum over all rows before in this order."""
    rows = ranges(df.withColumns(values), *order)
    every = rows.groupBy("part").agg(*[F.sum(v).alias(f"{v}_in") for v in values])
    up = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    every = every.select("part", *[F.coalesce(F.sum(f"{v}_in").over(up), F.lit(0)).alias(f"{v}_up") for v in values])
    within = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.join(every, "part").select(*df.columns, *[(F.col(f"{v}_up") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(v) for v in values])


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """sources (src, source_size) with target: fill to the limits in the order of limit / weight."""
    by_name = F.col("src").asc_nulls_last()
    ranked = running(sources, [by_name], place=F.lit(1).cast("long"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("w")).drop("place")
    before = running(ranked, [F.col("ratio").asc(), by_name], cap_before=F.col("cap"), w_before=F.col("w"))
    total = ranked.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w_total"))
    level = (F.lit(share) * F.col("total") - F.col("cap_before")) / (F.col("w_total") - F.col("w_before"))
    # the first source whose limit is not below its share sets the level for all that follow
    found = before.crossJoin(F.broadcast(total)).withColumn("level", level)  # total: one row
    final = found.agg(F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("ratio", "level"))).getField("level").alias("final"))
    target = F.least(F.coalesce(F.col("final") * F.col("w"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return found.crossJoin(F.broadcast(final)).select("src", "source_size", target.alias("target"))  # final: one row


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one for each row of docs.

    quality: optional (id, weight > 0) rows, one for each id at most; ids without one weigh 1.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), words(F.col(text_col)).alias("size"))
    if quality is None:
        rows = rows.withColumn("q", F.lit(1.0))
    else:
        q = quality.toDF("doc_id", "q")
        rows = rows.join(q, "doc_id", "left").withColumn("q", F.greatest(F.coalesce(F.col("q").cast("double"), F.lit(1.0)), F.lit(1e-6)))
    rows = B.store(rows.withColumn("key", -F.log(uniform(F.col("doc_id"))) / F.col("q")), "sizes")
    sources = B.store(rows.groupBy("src").agg(F.sum("size").alias("source_size")), "sources")
    goal = targets(sources, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = B.store(goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "goal")

    by_name = F.col("src").asc_nulls_last()
    keyed = ranges(rows, by_name, F.col("key"), F.col("doc_id"), F.col("size")).withColumnRenamed("part", "bucket")
    sums = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = sums.select("src", "bucket", F.coalesce(F.sum("in_bucket").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    earlier = B.store(earlier, "prefix")
    same = keyed["src"].eqNullSafe(earlier["src"]) & (keyed["bucket"] == earlier["bucket"])
    within = W.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    run = keyed.join(earlier, same, "left").select(keyed["*"], earlier["earlier"]).withColumn("upto", F.col("earlier") + F.sum("size").over(within))
    run = run.join(goal, run["src"].eqNullSafe(goal["src"]), "left").select(run["*"], *[goal[c] for c in ("source_size", "target", "epochs", "rest")])
    run = B.store(run.withColumn("whole", F.col("upto") <= F.col("rest")), "run")
    gaps = run.groupBy("src").agg((F.max("rest") - F.coalesce(F.max(F.when(F.col("whole"), F.col("upto"))), F.lit(0))).alias("gap"))
    gaps = B.store(gaps, "gaps")
    open_ = run.where("not whole and size > 0").join(gaps, run["src"].eqNullSafe(gaps["src"])).select(run["src"], "gap", "key", "doc_id", "size")
    miss = F.abs(F.col("size") - F.col("gap"))
    last = open_.where(miss < F.col("gap")).groupBy("src").agg(F.min(F.struct(miss.alias("miss"), "key", "doc_id", "size")).alias("best"))
    last = B.store(last, "last").select(F.col("src").alias("l_src"), F.col("best.key").alias("l_key"), F.col("best.doc_id").alias("l_id"), F.col("best.size").alias("l_size"))
    out = run.join(last, run["src"].eqNullSafe(last["l_src"]), "left")
    extra = (F.col("key") == F.col("l_key")) & F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("size") == F.col("l_size"))
    extra = F.coalesce(extra, F.lit(False)) & ~F.col("whole")
    # a partial pass never takes a document twice: whole and extra exclude each other
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("whole") | extra, 1).otherwise(0))
    return out.select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))


SQL = """
WITH q AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
r AS (SELECT d.doc_id, d.source AS src, coalesce(len(regexp_extract_all(d."text", '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
      -ln((('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / coalesce(q.q, 1.0::DOUBLE) AS k
      FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM r GROUP BY src),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w, source_size * 2 AS cap FROM s),
v AS (SELECT *, cap / w AS ratio, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s)
        - coalesce(sum(cap) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(w) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM w),
f AS (SELECT (SELECT level FROM v WHERE level * w <= cap ORDER BY ratio LIMIT 1) AS final),
g0 AS (SELECT src, source_size, least(coalesce(final * w, cap::DOUBLE), cap::DOUBLE) AS target FROM v, f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
      target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS rest FROM g0),
u AS (SELECT r.*, g.source_size, g.target, g.epochs, g.rest,
      sum(size) OVER (PARTITION BY r.src ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM r JOIN g ON r.src IS NOT DISTINCT FROM g.src),
t AS (SELECT *, upto <= rest AS whole, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY src), 0) AS gap FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY src, (NOT whole AND size > 0 AND abs(size - gap) < gap) ORDER BY abs(size - gap), k, doc_id, size) AS rn FROM t)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN whole OR (rn = 1 AND NOT whole AND size > 0 AND abs(size - gap) < gap) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
