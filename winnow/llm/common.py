"""What the operators share: cutting lineage, reading tables, groups from pairs.

Every operator selects the columns that it names before anything else, so further columns of the input, whatever their
names, neither clash nor travel. Rows whose id is null cannot be named in a result and are left out.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Hashable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """One object per worker process and key, for all of an operator's tasks there, until those of another call forget()."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Give back what another operator's tasks kept in this worker process: workers outlive stages, and share their executor's memory."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # glibc's own
            ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where it names none, in local mode, one of our own. On a
    cluster that names none this is an error: executors do not share a machine's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="winnow-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: its later uses survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id bigint, text string) of the rows that have an id."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, group): for each id in pairs the least id of its connected component.

    Alternates large-star and small-star steps until neither changes an edge; each round is cut, so the plan stays short,
    and takes O(log n) rounds. Self pairs and repeated pairs are harmless; empty input gives an empty result.
    """
    edges = cut(pairs.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = cut(small)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group")).union(edges.select(F.col("v"), F.col("v")).distinct())


def class_report(every: DataFrame, members: DataFrame, reps: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, n_links, group_id) of each id of every (id).

    members (id, h): an id's class is known by h; reps (c, h, rep): the classes, numbered, and their least ids; links (a, b): distinct
    pairs of class numbers. An id with several classes has the least class and group and the most links; one without is its own.
    """
    links = cut(links)
    n = links.select(F.col("a").alias("c")).union(links.select("b")).groupBy("c").agg(F.count("*").alias("n"))
    found = reps.join(n, "c", "left").join(groups(links).select(F.col("id").alias("c"), "group"), "c", "left")
    found = cut(found.select("h", "rep", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("group", "c").alias("group")))
    least = found.groupBy("group").agg(F.min("rep").alias("least"))
    known = members.join(found, "h").join(least, "group").select("id", "rep", "n", "least")
    none = F.lit(None).cast("bigint")
    blank = every.select("id", none.alias("rep"), F.lit(0).cast("bigint").alias("n"), none.alias("least"))
    one = known.union(blank).groupBy("id").agg(F.min("rep").alias("rep"), F.max("n").alias("n"), F.min("least").alias("least"))
    return one.select("id", F.coalesce("rep", "id").alias("class_id"), F.col("n").alias("n_links"), F.coalesce("least", "id").alias("group_id"))
