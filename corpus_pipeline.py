"""A corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, and the mix.

Every stage takes documents (doc_id, text, lang, source, n_chars and any further columns), null in any column, and an empty
table, which stays empty; columns of the operators' own carry names of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import _base as B
from plumbline.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from plumbline.llm.queries import label_weights

ORACLE_SQL = None  # language ID can't be expressed in SQL; tests compare with brute force
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Documents whose language is recognised with a posterior of at least `least`; letterless texts go.

    Null, empty and letterless texts have no language and go; a null lang teaches nothing and doesn't matter to its own
    row; without any lang to learn from all go; rows that repeat are judged alike, and a tie of two languages passes at 0.5.
    The posterior is over whole texts and near 1 for all but the shortest, so what goes are texts without a language,
    not those that are hard to tell.
    """
    model = language_id.learn(docs)
    seen = language_id.predict(docs, model, docs.columns, names=("__lang", "__score"))
    return seen.where((F.col("__lang") != language_id.NO_LETTER) & (F.col("__score") >= least)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines found in ten or more; n_chars follows the text; emptied ones go.

    A null text is one empty line, as an empty one is; both become empty. What loses no line stays, null and
    empty texts too, where fewer than ten rows have that line. Rows that repeat an id are documents of their own, so ten copies
    of one text lose all their lines.
    """
    out = line_dedup.line_dedup(docs, min_docs=10, prefix="__")
    out = out.where((F.col("__n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) != ""))
    return out.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id; rows that repeat this id are the same document and stay.

    Texts without words, null ones too, are in no group and stay; so do rows without an id. Ties at 80 hundredths are in one group.
    """
    found = near_dedup.near_duplicates(docs, percent=80)
    rest = B.store(found.where("not kept").select("doc_id").distinct(), "repeats")
    return docs.join(B.bounded_broadcast(rest, rest.count()), "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.

    Null and wordless texts hold none and stay; rows without an id are judged by their text; of rows that repeat
    an id only those whose text is hit go; items without words, and an empty benchmark, hit nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    runs = decontamination.hits(docs, items, width=10).select("doc_id", "text_hash").distinct()
    runs = B.store(runs, "leaks").toDF("__id", "__hash")
    rows = docs.withColumn("__own", F.xxhash64("text"))
    left = rows.join(B.bounded_broadcast(runs, runs.count()), rows["doc_id"].eqNullSafe(runs["__id"]) & (rows["__own"] == runs["__hash"]), "left_anti")
    return left.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: (doc_id, source, size, source_size, target, taken).

    All rows come back; null and empty texts have size 0 and take 0; a null source is one of its own, the last;
    labels without a quality, and documents without a label, weigh 1; rows that repeat an id share its place in the order.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix(docs, quality=label_weights(labels))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = B.store(docs, name)
    return docs
