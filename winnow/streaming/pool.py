"""The bounded pool, refreshed by micro-batches: each batch is one round, each version a new folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.mixing import upsert_pool
from winnow.sources.readers import exists


def refresh(stream: DataFrame, folder: str, checkpoint: str, least: float = 0.85, size: int = 5000):
    """Starts the query. A batch that is run again writes the same version, so nothing counts twice."""
    spark: SparkSession = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = f"{folder}/{number - 1}"
        old = spark.read.parquet(before) if number and exists(spark, before) else batch.limit(0).withColumn("round_added", F.lit(None).cast("int"))
        upsert_pool(old, batch, number, least, size).write.mode("overwrite").parquet(f"{folder}/{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
