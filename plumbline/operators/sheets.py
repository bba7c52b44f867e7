"""Extracted sheets: empty ones, failed ones, merged pages, counts, gates and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.operators import annotations as A
from plumbline.operators import responses as P
from plumbline.operators.rules import SHEET

ARRAYS = ["rooms", "doors", "corridors", "stairs", "egress_paths", "dimensions"]
SCALARS = ["occupancy_type", "building_type"]
# fixed values: warnings
SKIPPED = ": extraction empty — skipping compliance pass"
NO_CORPUS = "building_code_chunks table is empty — ingest a code PDF (npm run ingest <pdf>) before compliance can cite sections"
UNSURE = "could not verify building_code_chunks table — compliance results may be degraded"


def schema() -> T.StructType:
    return T.StructType.fromDDL(SHEET)


def no_annotations() -> Column:
    return F.struct(*[F.array().cast("array<string>").alias(b) for b in A.BUCKETS])


def empty(named: DataFrame, *keep: str) -> DataFrame:
    """Sheets without content. named: sheet_name, file_type and the columns to keep."""
    blank = {f.name: F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast(f.dataType) for f in schema()[2:]}
    return named.select(*keep, "sheet_name", "file_type", *[(no_annotations() if c == "annotations" else v).alias(c) for c, v in blank.items()])


def with_other(annotations: Column, *more: Column) -> Column:
    """The buckets with entries more in `other`; a null one is left out."""
    return annotations.withField("other", F.concat(F.coalesce(annotations["other"], F.array().cast("array<string>")), F.array_compact(F.array(*more))))


def failed(files: DataFrame, *keep: str) -> DataFrame:
    """Empty sheets of files that could not be parsed, which say so. files: sheet_name, file_type, error."""
    message = F.concat(F.lit("PARSE_ERROR: "), F.coalesce(F.col("error"), F.lit("parse failed")))
    return empty(files, *keep, "error").withColumn("annotations", with_other(F.col("annotations"), message)).drop("error")


def merged(raw: DataFrame, *keep: str) -> DataFrame:
    """One sheet for each raw extraction: arrays or none, name and type or those given, annotations as buckets.

    raw: given_name, given_type, the columns of a sheet (null where the model gave none), and `notes`, its annotations
    as a list of texts (null: as buckets). Each row needs a name of its own in given_name.
    """
    none = [F.coalesce(F.col(c), F.array().cast(raw.schema[c].dataType)).alias(c) for c in ARRAYS]
    notes = raw.select("given_name", F.posexplode("notes").alias("pos", "text"))
    routed = A.buckets(A.categorize(notes, "given_name", "text"), "given_name").withColumnRenamed("annotations", "__own")
    rows = raw.join(routed, "given_name", "left")
    own = F.when(F.col("notes").isNotNull(), F.coalesce("__own", no_annotations())).otherwise(F.coalesce("annotations", no_annotations()))
    name, kind = F.coalesce(X.blank_null(F.col("sheet_name")), "given_name"), F.coalesce(X.blank_null(F.col("file_type")), "given_type")
    return rows.select(*keep, name.alias("sheet_name"), kind.alias("file_type"), *none, own.alias("annotations"), *SCALARS)


def combined(pages: DataFrame, key: str, page: str, hints: DataFrame | None = None, limit: int = 6) -> DataFrame:
    """(key, arrays, annotations, scalars): the first pages of a sheet as one.

    pages: key, page, the arrays and scalars of a sheet, `notes` (texts to be routed) and `annotations` (buckets made
    already), null where a page has none. hints: (key, hint), a sheet's own text, routed after all pages' notes. Made
    buckets follow the routed ones page by page, and what occurs in both stays twice.
    """
    own = P.merge_pages(pages, key, page, ARRAYS, SCALARS, limit)
    first = pages.where(F.col(page) <= limit)
    notes = first.select(key, F.col(page).cast("long").alias("p"), F.posexplode("notes").alias("i", "text"))
    if hints is not None:
        notes = notes.unionByName(hints.where("hint <> ''").select(key, F.lit(1 << 62).cast("long").alias("p"), F.lit(0).alias("i"), F.col("hint").alias("text")))
    notes = notes.select(key, F.struct("p", "i").alias("pos"), "text")
    routed = A.buckets(A.categorize(notes, key, "text"), key)
    made = first.where("annotations is not null").select(key, page, *[F.col(f"annotations.{b}").alias(b) for b in A.BUCKETS])
    made = P.merge_pages(made, key, page, A.BUCKETS, [], limit).select(key, F.struct(*A.BUCKETS).alias("__made"))
    rows = own.join(routed, key, "left").join(made, key, "left")

    def both(b: str) -> Column:
        parts = [F.coalesce(F.col(f"{x}.{b}"), F.array().cast("array<string>")) for x in ("annotations", "__made")]
        return F.concat(*parts).alias(b)

    return rows.select(key, *ARRAYS, F.struct(*[both(b) for b in A.BUCKETS]).alias("annotations"), *SCALARS)


def counts(sheets: DataFrame, *keep: str) -> DataFrame:
    """How many elements of each kind, and annotations, a sheet has."""
    sizes = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c) for c in ARRAYS]
    return sheets.select(*keep, *sizes, A.total().cast("long").alias("annotations"))


def usable(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sheets that compliance reads, and a warning for each of the others."""
    good = A.usable()
    return sheets.where(good), sheets.where(~good).select(F.concat("sheet_name", F.lit(SKIPPED)).alias("warning"))


def corpus_warning(spark: SparkSession, chunks: int) -> DataFrame:
    """What the number of chunks (-1: unknown) warns of."""
    rows = [(NO_CORPUS,)] if chunks == 0 else [(UNSURE,)] if chunks < 0 else []
    return spark.createDataFrame(rows, "warning string")


def for_model(sheets: DataFrame, chunks: int) -> DataFrame:
    """The sheets that the model pass reads: none with an empty corpus. Rules read the usable ones all the same."""
    return usable(sheets)[0].where(F.lit(chunks != 0))


def warnings(*frames: DataFrame) -> DataFrame:
    """All warnings of a run, with the order of their sources."""
    rows = [f.select(F.lit(i).alias("source"), "warning") for i, f in enumerate(frames)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def capped(values: Column, limit: int) -> tuple[Column, Column]:
    """What is shown of a list (12 dimensions, 8 annotations of a group), and how many more there are."""
    return F.slice(values, 1, limit), F.greatest(F.size(values) - limit, F.lit(0)).cast("long")


def as_json(sheet: Column) -> Column:
    """A sheet as JSON, for storage and for a model."""
    return F.to_json(sheet)
