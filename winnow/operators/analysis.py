"""Tables over results: method by benchmark, ablation, efficiency, sweeps, raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions import text as T


def grid(results: DataFrame) -> DataFrame:
    """(method, benchmark, score) of every method with every benchmark; a missing score is null. A repeated cell is an error."""
    twice = results.groupBy("method", "benchmark").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two results for {twice[0]['method']} on {twice[0]['benchmark']}")
    methods, names = results.select("method").distinct(), results.select("benchmark").distinct()
    return methods.crossJoin(names).join(results.select("method", "benchmark", "score"), ["method", "benchmark"], "left")  # names only: a small grid


def pivot(results: DataFrame, benchmarks: Sequence[str] | None = None) -> DataFrame:
    """A row per method with a formatted cell per benchmark."""
    names = list(benchmarks) if benchmarks is not None else [r[0] for r in results.select("benchmark").distinct().orderBy("benchmark").collect()]
    wide = grid(results).groupBy("method").pivot("benchmark", names).agg(F.first("score"))
    return wide.select("method", *[T.cell(F.col(f"`{n}`")).alias(n) for n in names])


def ablation(results: DataFrame, full: str = "full") -> DataFrame:
    """(method, benchmark, cell): each score with its distance from the method `full`, where that has one."""
    base = results.filter(F.col("method") == full).select("benchmark", F.col("score").alias("reference"))
    both = grid(results).join(base, "benchmark", "left")
    return both.select("method", "benchmark", F.when(F.col("method") == full, T.cell(F.col("score"))).otherwise(T.delta_cell(F.col("score"), F.col("reference"))).alias("cell"))


def efficiency(runs: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("prep_sec", "train_sec", "eval_sec")]
    return runs.withColumn("total_sec", sum(parts[1:], parts[0])).orderBy("total_sec", "method")


def sweep(results: DataFrame) -> DataFrame:
    """(benchmark, series): (theta, score) by rising theta; theta from a folder name such as theta_0p55."""
    theta = F.replace(F.regexp_extract("run", r"theta[_-]?(\d+p\d+|\d+\.\d+)", 1), F.lit("p"), F.lit(".")).cast("double")
    rows = results.filter(F.col("run").rlike(r"theta[_-]?(\d+p\d+|\d+\.\d+)")).select("benchmark", F.struct(theta.alias("theta"), F.col("score").alias("score")).alias("x"))
    return rows.groupBy("benchmark").agg(F.sort_array(F.collect_list("x")).alias("series"))


def win_rates(ratings: DataFrame, raters: Sequence[str]) -> DataFrame:
    """(label, n, rate) of the valid labels of all raters."""
    said = ratings.select(F.explode(F.array(*[T.rater_label(F.col(r)) for r in raters])).alias("label")).filter("label IS NOT NULL")
    counts = ratings.sparkSession.createDataFrame([("a",), ("b",), ("tie",)], "label string").join(said.groupBy("label").agg(F.count("*").alias("n")), "label", "left").na.fill(0)
    return counts.crossJoin(counts.agg(F.greatest(F.sum("n"), F.lit(1)).alias("t"))).select("label", "n", (F.col("n") / F.col("t")).alias("rate"))  # three rows by one


def kappa(ratings: DataFrame, first: str, second: str) -> DataFrame:
    """One row (n, agreement, kappa) over rows that both rated; if chance agreement is 1, kappa is 1 for full agreement, else 0."""
    rows = ratings.select(T.rater_label(F.col(first)).alias("x"), T.rater_label(F.col(second)).alias("y")).na.drop()
    mean = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    shares = [mean(F.col(c) == v).alias(f"{c}_{v}") for c in "xy" for v in ("a", "b", "tie")]
    one = rows.agg(F.count("*").alias("n"), mean(F.col("x") == F.col("y")).alias("agreement"), *shares)
    chance = sum((F.col(f"x_{v}") * F.col(f"y_{v}") for v in ("a", "b", "tie")), F.lit(0.0))
    k = F.when(1 - chance < 1e-12, (F.col("agreement") >= 1).cast("double")).otherwise(F.try_divide(F.col("agreement") - chance, 1 - chance))
    return one.select("n", "agreement", F.when(F.col("n") == 0, 0.0).otherwise(k).alias("kappa"))
