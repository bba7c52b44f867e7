"""The ten queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, exact_dedup, html_text, language_id, language_model, lexical_search, line_dedup, mixing, near_dedup, prefix_trie, quality, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; see html_text."""
    return html_text.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept lines of every document as a digest; see line_dedup."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.line_dedup(docs, "text", min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (SELECT rid, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce("text", ''), chr(10)) AS ls FROM documents))),
c AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT any_value(l.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(c.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.k IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.k = c.k GROUP BY l.rid
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document; see decontamination."""
    out = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    joined = F.array_join("items", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files; see token_counts."""
    blocks, stop, kind = token_counts.write_tokens(_table(spark, sf_dir, "documents"))
    return token_counts.count_tokens(blocks, stop, kind)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them; see language_id."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.fold(F.col("doc_id"), 3) == 1
    model = language_id.learn(docs.where(~held))
    return language_id.predict(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from weak labels; see quality."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs), ["doc_id"])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 85 hundredths; see near_dedup."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights of labelled documents: 2 if a row says good, else 0.5."""
    return labels.where("quality is not null").groupBy("doc_id").agg(F.when(F.max("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix over all documents; see mixing."""
    weights = label_weights(_table(spark, sf_dir, "labels"))
    return mixing.mix(_table(spark, sf_dir, "documents"), quality=weights).drop("source")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95; see embedding_dedup."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.95)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from four fifths of them; see language_model."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language_model.fold(F.col("doc_id"), 5) == 1
    model = language_model.learn(docs.where(~held))
    return language_model.score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations; see prefix_trie."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item; see lexical_search."""
    index = lexical_search.build_index(_table(spark, sf_dir, "documents"))
    return lexical_search.search(index, _table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents; see exact_dedup."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {"op1_html_text": op1_html_text, "op2_line_dedup": op2_line_dedup, "op3_decontamination": op3_decontamination, "op4_token_counts": op4_token_counts, "op5_language_id": op5_language_id, "op6_quality": op6_quality, "op7_near_dedup": op7_near_dedup, "op8_mixing": op8_mixing, "op9_embedding_dedup": op9_embedding_dedup, "op10_language_model": op10_language_model, "op11_prefix_trie": op11_prefix_trie, "op12_lexical_search": op12_lexical_search, "op13_exact_dedup": op13_exact_dedup}
SQL = {"op2_line_dedup": OP2_SQL, "op3_decontamination": decontamination.SQL, "op7_near_dedup": near_dedup.SQL, "op8_mixing": mixing.SQL, "op9_embedding_dedup": embedding_dedup.SQL, "op11_prefix_trie": prefix_trie.SQL, "op12_lexical_search": lexical_search.SQL, "op13_exact_dedup": exact_dedup.SQL}
