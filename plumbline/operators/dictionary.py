"""A dictionary of a corpus: which of its words hold a text, and which documents hold these words.

A text without a gap (white space, or for keywords any sign but a letter or digit) occurs in a document if it occurs in one of the document's
words. So texts meet the distinct words of the corpus, once each, and documents join only the words that were met: the work grows
with the corpus plus the texts, not with their product. Words of more than WINDOW signs are cut in windows that
overlap by OVERLAP signs, so a word of any length is handled in linear time; of a text longer than that overlap the first part is
looked up, and whoever asks checks what it finds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import shared

#: signs of a window, by which two overlap, and of the pieces by which words and texts are joined
WINDOW, OVERLAP, GRAM = 512, 128, 4
#: rows that may be broadcast, of texts of at most OVERLAP + 1 signs
FEW = 200_000
KEYWORD_GAP, BLANK_GAP = r"[^a-z0-9]+", r"[\x09-\x0D\x20]+"
#: parts by which stored postings are pruned
BUCKETS = 256
#: postings at most, on average, that a task stores
ROWS = 2_000_000


def words(docs: DataFrame, keep: list, low: Column, gap: str, least: int = 1) -> DataFrame:
    """(keep, word): the distinct words of each lower-cased text with at least so many signs; long ones as windows."""
    cut = rf"(?s)(?=(.{{1,{WINDOW}}})).{{1,{WINDOW - OVERLAP}}}"
    whole = docs.select(*keep, F.explode(F.array_distinct(F.split(low, gap))).alias("__whole")).where(F.length("__whole") >= least)
    parts = F.when(F.length("__whole") > WINDOW, F.regexp_extract_all("__whole", F.lit(cut), F.lit(1))).otherwise(F.array("__whole"))
    return whole.select("*", F.explode(parts).alias("word")).drop("__whole")


def few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most FEW rows."""
    return F.broadcast(df) if len(df.take(FEW + 1)) <= FEW else df


def _grams(df: DataFrame, c: str, sizes: list[int]) -> DataFrame:
    """df with n and gram: the pieces of c of each size, each once."""
    sized = df.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.length(c) >= F.col("n"))
    pieces = F.transform(F.sequence(F.lit(1), F.length(c) - F.col("n") + 1), lambda at: F.substring(F.col(c), at, F.col("n")))
    return sized.withColumn("gram", F.explode(F.array_distinct(pieces)))


def vocabulary(rows: DataFrame, id: str) -> DataFrame:
    """(word, first): the distinct words of rows, each with its least id, or null if one of its ids is null."""
    return rows.groupBy("word").agg(F.when(F.count(id) == F.count("*"), F.min(id)).alias("first"))


def holding(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(text, word): the words that hold each text, or the first OVERLAP + 1 signs of a longer one.

    texts: (text), not empty and without gaps; vocabulary: (word), each once, with any further columns, which are kept. Each text is
    joined by that of its grams that the fewest words have, texts shorter than GRAM by themselves; a text with a gram that no word has is in no word.
    """
    asked = shared.stored(texts.select("text").distinct().withColumn("probe", F.left("text", F.lit(OVERLAP + 1))), "texts")
    asked = asked.withColumn("size", F.least(F.length("probe"), F.lit(GRAM)))
    sizes = sorted(r.size for r in asked.select("size").distinct().collect())  # GRAM rows at most
    if not sizes:
        return asked.select("text", *[F.lit(None).cast(kind).alias(c) for c, kind in vocabulary.dtypes])
    each = _grams(asked, "probe", sizes).where("n = size").select("text", "probe", "gram")
    wanted = each.select("gram").distinct()
    listed = _grams(vocabulary, "word", sizes).drop("n").join(few(wanted), "gram", "left_semi")
    counts = listed.groupBy("gram").agg(F.count("*").alias("words"))
    best = each.join(counts, "gram", "left").groupBy("text", "probe").agg(F.min("words").alias("words"), F.min_by("gram", "words").alias("gram"), F.bool_and(F.col("words").isNotNull()).alias("known"))
    best = shared.stored(best.where("known").select("text", "probe", "gram"), "keys")
    return listed.join(few(best), "gram").where(F.contains("word", "probe")).select("text", *vocabulary.columns)


def build(chunks: DataFrame, keep: list[str], low: Column, gap: str, path: str, least: int = 1) -> None:
    """Store the dictionary of a corpus at path: `words` (word, and first of keep's first column) and `postings` (word, and keep of its document), dealt to BUCKETS parts by word.

    Tasks that store postings are as many as the length of the texts asks for, so that none has more to sort where there are more texts.
    """
    spark = chunks.sparkSession
    rows = words(chunks, keep, low, gap, least)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/shape")
    most = (chunks.agg(F.sum(F.length(low) + 1)).first()[0] or 0) // (least + 1)  # a word has a gap behind it
    pieces = max(8, math.ceil(most / (BUCKETS * ROWS)))  # of a bucket
    tasks = min(BUCKETS * pieces, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(most / ROWS)))
    place = F.col("bucket") * pieces + F.pmod(F.xxhash64(*keep), F.lit(pieces)).cast("int")
    rows.repartitionById(tasks, place).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    vocabulary(_postings(spark, path), keep[0]).write.mode("overwrite").parquet(f"{path}/words")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    shape = spark.read.parquet(f"{path}/shape").schema  # postings of nothing have no file
    return spark.read.schema(shape).parquet(f"{path}/postings")


def postings(spark: SparkSession, path: str, met: DataFrame) -> DataFrame:
    """Rows of the stored dictionary for the words of met; only the parts that hold one of them are read."""
    buckets = [r.b for r in met.select(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]  # at most BUCKETS rows
    return _postings(spark, path).where(F.col("bucket").isin(buckets)).drop("bucket").join(few(met.select("word").distinct()), "word", "left_semi")
