"""Inputs derived from the test tables by SQL that reads the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = (
    "CASE l_partkey % 7 WHEN 0 THEN concat(n, 'mm') WHEN 1 THEN concat(n, '') WHEN 2 THEN concat(n // 1000, '.', lpad(concat(n % 1000, ''), 3, '0'), ' m') "
    "WHEN 3 THEN concat(n // 10, 'cm') WHEN 4 THEN concat(n // 25, '\"') WHEN 5 THEN concat(n // 305, '''-', n % 12, '\"') ELSE 'varies' END"
)
ELEMENT_INPUT = (
    "SELECT l.l_orderkey AS k, concat('S-', l.l_orderkey) AS sheet, concat('E-', l.l_partkey, '-', l.l_suppkey, '-', l.l_linenumber, '-', n) AS id, l_linenumber % 6 AS kind, "
    f"{RAW} AS raw, CASE o.o_custkey % 5 WHEN 0 THEN 'residential dwelling' WHEN 1 THEN 'assembly hall' WHEN 2 THEN 'warehouse industrial' WHEN 3 THEN c.c_mktsegment END AS occupancy "
    "FROM (SELECT *, 500 + 20 * CAST(l_quantity AS INT) AS n FROM lineitem) l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey"
)


def spark_sql(sql: str) -> str:
    return sql.replace("//", "DIV").replace("'''-'", "'\\'-'")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the test tables it names, read from sf_dir."""
    import re

    names = [n for n in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split() if re.search(rf"\b(FROM|JOIN) {n}\b", sql)]
    text = spark_sql(sql)
    for n in names:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **tables(spark, sf_dir, *names)) if names else spark.sql(text)
