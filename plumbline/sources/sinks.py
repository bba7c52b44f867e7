"""Tables that a run writes: plans, sheets, violations, chunks, rules, drafts and results, as Parquet or JSON folders.

Parquet has no updates: states are appended and the last one holds. Every write is one distributed append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import rules as R

VIOLATION = ["type", "severity", "description", "section_id", "code_citation", "affected_sheets", "location_hint", "source"]


def ident(*keys) -> Column:
    """An id that reruns reproduce."""
    return F.sha2(F.concat_ws("\u0001", *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys]), 256)


def append(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("append").parquet(path)
    return df


def plans(uploads: DataFrame, key: str = "request") -> DataFrame:
    """(id, project_name, status, at): a new plan for each request. uploads: key, project_name, file_name."""
    first = uploads.where("file_name is not null").groupBy(key).agg(F.min(F.coalesce(X.blank_null(F.col("project_name")), F.lit("Untitled Project"))).alias("project_name"))
    return first.select(ident(key, "project_name").alias("id"), "project_name", F.lit("processing").alias("status"), F.lit(0).alias("step"))


def completed(made: DataFrame) -> DataFrame:
    """The rows that set plans to complete."""
    return made.select("id", "project_name", F.lit("complete").alias("status"), (F.col("step") + 1).alias("step"))


def current(states: DataFrame) -> DataFrame:
    """The last state of each plan."""
    last = W.partitionBy("id").orderBy(F.desc("step"))
    return states.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def plan_sheets(sheets: DataFrame) -> DataFrame:
    """(id, plan_id, sheet_name, file_type, storage_path, extracted_data): rows of sheets. sheets: plan_id, storage_path, sheet."""
    return sheets.select(ident("plan_id", "sheet.sheet_name").alias("id"), "plan_id", F.col("sheet.sheet_name").alias("sheet_name"), F.col("sheet.file_type").alias("file_type"), "storage_path", F.col("sheet").alias("extracted_data"))


def violation_rows(found: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Rows of violations; columns that found lacks are null."""
    arrays = {"affected_sheets": "array<string>"}
    cols = [F.col(c) if c in found.columns else F.lit(None).cast(arrays.get(c, "string")).alias(c) for c in VIOLATION]
    return found.select(F.col(plan).alias("plan_id"), *cols)


def embedded() -> Column:
    return F.coalesce(F.size("embedding"), F.lit(0)) > 0


def chunk_rows(chunks: DataFrame, jurisdiction: str = "NBC", run: str = "", place: tuple[str, ...] = ()) -> DataFrame:
    """Rows of embedded chunks; those without a vector are left out. chunks: section_id, section_title, content, embedding.

    Append-only: what is ingested twice is there twice. The id is made of the run's name, the columns of `place` and the
    content: give each ingest a name, and the columns that tell a document's chunks apart (its key, ordinal), and every row has an
    id of its own, the same when the run is repeated after a failure. Without them equal chunks share one.
    """
    rows = chunks.where(embedded())
    made = ident(F.lit(run), *place, "section_id", "section_title", "content") if run or place else ident("section_id", "section_title", "content")
    return rows.select(made.alias("id"), "section_id", "section_title", "content", "embedding", F.lit(jurisdiction).alias("jurisdiction"), X.topics(F.col("section_title")).alias("topic"))


def ingest_counts(chunks: DataFrame) -> DataFrame:
    """(chunks_parsed, chunks_ingested), in one pass."""
    return chunks.agg(F.count("*").alias("chunks_parsed"), F.count_if(embedded()).alias("chunks_ingested"))


def write_guarded(rows: DataFrame, checks: dict[str, Column], path: str, rejected: str) -> dict[str, int]:
    """Append the rows that meet all checks to path, the others with the names of those they fail (`failed`) to rejected.

    Returns how many rows there were and were written, and how many fail each check, counted while they are written: only where
    some fail are rows read a second time. A check that is null fails.
    """
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    marked, seen = rows.withColumn("failed", failed), Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.size("failed") == 0).alias("written"), *[F.count_if(F.array_contains("failed", n)).alias(n) for n in checks]]
    marked.observe(seen, *counts).where(F.size("failed") == 0).drop("failed").write.mode("append").parquet(path)
    found = seen.get
    if found["written"] < found["rows"]:
        marked.where(F.size("failed") > 0).write.mode("append").parquet(rejected)
    return found


def ingest_request(requests: DataFrame) -> DataFrame:
    """requests (file_path, jurisdiction) with defaults, `local`, and the error of those without a path."""
    path = F.col("file_path")
    local = path.startswith("/") | path.startswith("./") | path.startswith("../")
    bad = F.when(F.coalesce(path, F.lit("")) == "", "file_path required")
    return requests.withColumns({"jurisdiction": F.coalesce("jurisdiction", F.lit("NBC")), "local": F.coalesce(local, F.lit(False)), "error": bad})


def count_chunks(spark: SparkSession, path: str) -> int:
    """Number of stored chunks; -1 where it can't be told."""
    try:
        return spark.read.parquet(path).count()
    except Exception:  # noqa: BLE001  whatever the store says
        return -1


def upsert_rules(spark: SparkSession, rules: DataFrame, path: str, out: str) -> int:
    """Validate rules, put them in the place of those at path with their ids, write all to out; returns how many came.

    Where rules fail, nothing is written but all errors, to `<out>-errors`. A rule's number is its place in its file.
    """
    R.checked(rules.withColumn("i", F.monotonically_increasing_id()), f"{out.rstrip('/')}-errors")
    R.upsert(spark.read.schema(R.RULE).parquet(path), rules).write.mode("overwrite").parquet(out)
    return rules.count()


def write_drafts(drafts: DataFrame, path: str) -> None:
    """Rule drafts as JSON lines for curation."""
    drafts.select("section", "direction", "value", "unit", "snippet").write.mode("overwrite").json(path)


def surviving(rows: DataFrame, kept_plans: DataFrame) -> DataFrame:
    """Rows of plans that still exist: what a cascading delete leaves."""
    return rows.join(kept_plans.select(F.col("id").alias("plan_id")), "plan_id", "left_semi")


def results(made: DataFrame, sheets: DataFrame, found: DataFrame, warned: DataFrame) -> DataFrame:
    """(plan_id, result): the answer to each request as JSON.

    sheets: (plan_id, place, sheet), found: (plan_id, place, columns of a violation), warned: (plan_id, place, warning).
    """
    def listed(df: DataFrame, value: Column, name: str) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct("place", value.alias("v"))))
        return df.groupBy("plan_id").agg(F.transform(own, lambda x: x["v"]).alias(name))

    shown = listed(found, F.struct(*VIOLATION), "violations")
    rows = made.select(F.col("id").alias("plan_id")).join(shown, "plan_id", "left").join(listed(sheets, F.col("sheet"), "sheets"), "plan_id", "left")
    rows = rows.join(R.summary(found, "plan_id"), "plan_id", "left").join(listed(warned, F.col("warning"), "warnings"), "plan_id", "left")
    parts = ["critical", "major", "minor", "compliance", "consistency"]
    none = F.array().cast(shown.schema["violations"].dataType)
    body = F.struct("plan_id", F.coalesce("violations", none).alias("violations"), "sheets", F.coalesce(F.size("sheets"), F.lit(0)).alias("sheets_analyzed"), F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in parts]).alias("summary"), "warnings")
    return rows.select("plan_id", F.to_json(body).alias("result"))


def errors(failed: DataFrame) -> DataFrame:
    """(status, result): error answers as JSON. failed: status, error, detail."""
    return failed.select("status", F.to_json(F.struct("error", "detail")).alias("result"))
