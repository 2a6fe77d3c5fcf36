"""Row numbers over a whole table without a single-task window: ranges are sorted in parallel and numbered by their offsets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from tempfile import mkdtemp

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, one of our own in local mode, while on a
    cluster, whose executors share no machine's folder, that is an error."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or mkdtemp(prefix="winnow-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "n") -> DataFrame:
    """df with name = 1, 2, ... in the given order. The order must be total for a repeatable result."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())  # a row per partition
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    base = reduce(lambda c, x: F.when(F.col("__part") == x[0], F.lit(x[1])).otherwise(c), before, F.lit(0)) if len(before) < 200 else F.create_map(*[F.lit(v) for x in before for v in x])[F.col("__part")]
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn(name, (within + base).cast("bigint")).drop("__part")
