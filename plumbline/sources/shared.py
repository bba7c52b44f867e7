"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only on a local master where nothing is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_plumbline_shared", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = sc._plumbline_shared = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="plumbline-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{folder(spark)}/plumbline-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """df written, to path if one is given, and read back."""
    spark = df.sparkSession
    path = path or new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
