"""A stream of sheet files through the rule engine: violations as they come, and counts of each sheet kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import rules as R


def violations_of_stream(spark: SparkSession, path: str, rules: DataFrame) -> DataFrame:
    """Violations of each sheet document (JSON) that arrives under path."""
    return R.violations(R.flatten_sheets(spark.readStream.schema(R.SHEET).json(path)), rules)


def write_violations(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batches(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Violations of each batch in a folder of its number, which a repeated batch replaces: a restart neither loses nor doubles any."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_summaries(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts by severity and type of each sheet over all batches so far (state); each batch stores the sheets it has changed."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    per = R.summary(found.withColumn("sheet", F.element_at("affected_sheets", 1)), "sheet")
    return per.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """The last stored counts of each sheet."""
    last = W.partitionBy("sheet").orderBy(F.desc("batch"))
    return spark.read.parquet(path).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "batch")
