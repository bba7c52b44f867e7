"""Running counts and last values along documents whose lines are rows.

A document's lines are cut in blocks of SIZE rows, each a key of its own in the window, so one long document is many tasks. What the
blocks of long documents pass on, one row a block, is summed along each document and joined to the blocks behind; documents
of one block take no part in that, and where there are only such ones, that step is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIZE = 4096
#: blocks whose ends may be broadcast
FEW = 200_000


def carried(rows: DataFrame, key: str, pos: str, long: Column, counts: dict[str, Column], lasts: dict[str, Column], size: int | None = None) -> DataFrame:
    """rows with, for each name, how many rows so far meet a condition, or the last value so far that isn't null.

    pos: a row's place from 0 on; long: whether its document may have more than `size` rows, told from the document alone.
    """
    size, kept = size or SIZE, rows.columns
    rows = rows.withColumn("__long", long).withColumn("__block", F.when(F.col("__long"), F.expr(f"`{pos}` div {size}")).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumns({**{"__c_" + n: F.when(c, 1) for n, c in counts.items()}, **{"__l_" + n: c for n, c in lasts.items()}})
    before = W.partitionBy("__key").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    place = F.when(F.col("__long"), F.col(pos))
    ends = rows.where("__long").groupBy(F.col(key).alias("__key"), F.col("__block").alias("__at")).agg(
        *[F.count("__c_" + n).alias("__c_" + n) for n in counts], *[F.max_by("__l_" + n, F.when(F.col("__l_" + n).isNotNull(), place)).alias("__l_" + n) for n in lasts]
    )
    ends = ends.select("__key", "__at", *[F.sum("__c_" + n).over(before).alias("__bc_" + n) for n in counts], *[F.last("__l_" + n, ignorenulls=True).over(before).alias("__bl_" + n) for n in lasts]).where("__at > 0")
    some = len(ends.take(FEW + 1))
    so_far = W.partitionBy(key, *["__block"] * bool(some)).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    own = rows.withColumns({**{n: F.count("__c_" + n).over(so_far) for n in counts}, **{n: F.last("__l_" + n, ignorenulls=True).over(so_far) for n in lasts}})
    if not some:
        return own.select(*kept, *counts, *lasts)
    met = own.join(F.broadcast(ends) if some <= FEW else ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__at")) & F.col("__long"), "left")
    sums = {**{n: F.col(n) + F.coalesce("__bc_" + n, F.lit(0)) for n in counts}, **{n: F.coalesce(n, "__bl_" + n) for n in lasts}}
    return met.withColumns(sums).select(*kept, *counts, *lasts)


def breaks(text: Column) -> Column:
    """How many line feeds a text has: a quick bound on its lines."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))
