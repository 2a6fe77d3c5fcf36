"""Mixing sources to target weights by weighted fair queueing.

Within its source every document has a place in a seeded shuffle (the md5 of seed and id); its virtual finish time is the
source's tokens up to and with it, divided by the source's target weight. Read by rising finish time, the sources come out
in proportion to their weights for as long as each lasts. The global order is a range sort by (finish, doc_id), cut where
the running total of tokens would pass the budget.

Neither running sum needs one task to see all of a source or of the corpus. The first is taken within slices of the
shuffle (source, leading hex digits of the key), to which the sums of earlier slices are added; the second within one
range only: whole ranges before the one where the budget ends are taken, whole ranges after it are dropped.

Defined results: tokens are runs of non-space characters; null or empty texts have none and cost nothing. A null source
is the source "". A source that `weights` does not name weighs `other`; one that weighs nothing, or less, is not mixed in. Ties
in finish time go by doc_id. Repeated doc_ids are independent documents: those of one source stand together, ordered by their
tokens, then by their texts' hash, and each costs its tokens. Rows without doc_id are left out. At budget 0 only documents
without tokens are taken; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import cut, partitions

BUDGET_SHARE = 0.5
SEED = 42
SLICE_DIGITS = 3
#: Target weights of the corpus's sources; what they do not name weighs OTHER.
WEIGHTS, OTHER = {"src0": 1.0, "src1": 2.0, "src2": 1.5, "src3": 1.0, "src4": 0.5, "src5": 1.0, "src6": 3.0, "src7": 1.0}, 1.0


def n_tokens(text) -> F.Column:
    """White-space separated words: the pieces that white space leaves, without the empty ones at the ends."""
    t = F.coalesce(text, F.lit(""))
    ends = F.left(t, F.lit(1)).rlike(r"\s").cast("int") + F.right(t, F.lit(1)).rlike(r"\s").cast("int")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")) - ends).cast("bigint")


def _identity(docs: DataFrame) -> list:
    """doc_id, source and the text's hash: what one row is known by."""
    return [F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.xxhash64(F.col("text").cast("string")).alias("h")]


def _ordered(docs: DataFrame, weights: dict[str, float] | None, other: float, budget_share: float, budget_tokens: int | None, seed: int) -> DataFrame:
    """(doc_id, source, h, tokens, finish, taken) of all documents that are mixed."""
    pick = F.lit(float(other))
    for k, v in (weights or {}).items():
        pick = F.when(F.col("source") == k, F.lit(float(v))).otherwise(pick)
    rows = docs.select(*_identity(docs), n_tokens(F.col("text").cast("string")).alias("tokens")).filter(F.col("doc_id").isNotNull()).withColumn("weight", pick).filter("weight > 0")
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))).withColumn("slice", F.left("key", F.lit(SLICE_DIGITS)))
    rows = cut(rows)
    slices = rows.groupBy("source", "slice").agg(F.sum("tokens").alias("n"))
    before = slices.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")).select("source", "slice", "before")
    within = F.sum("tokens").over(Window.partitionBy("source", "slice").orderBy("key", "doc_id", "tokens", "h").rowsBetween(Window.unboundedPreceding, 0))
    timed = rows.withColumn("within", within).join(before, ["source", "slice"])
    timed = timed.select("doc_id", "source", "h", "tokens", ((F.col("before") + F.col("within")) / F.col("weight")).alias("finish"))
    order = ["finish", "doc_id", "tokens", "h"]
    ranged = cut(timed.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    sums = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("tokens").alias("n")).collect())  # a row per partition
    if budget_tokens is None:
        budget_tokens = int(budget_share * sum(n for _, n in sums))
    total, edge, base = 0, None, 0
    for r, n in sums:
        if total + n > budget_tokens and edge is None:
            edge, base = r, total
        total += n
    if edge is None:
        return ranged.withColumn("taken", F.lit(True)).drop("range")
    part = ranged.filter(F.col("range") == edge).withColumn("run", F.sum("tokens").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(base))
    rest = ranged.filter(F.col("range") != edge).withColumn("taken", F.col("range") < edge)
    return rest.drop("range").union(part.withColumn("taken", F.col("run") <= budget_tokens).drop("range", "run"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, other: float = OTHER, budget_share: float = BUDGET_SHARE, budget_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, finish) of the documents taken, in their global order. The budget is budget_tokens or, by
    default, budget_share of the tokens of all sources that are mixed."""
    return _ordered(docs, weights, other, budget_share, budget_tokens, seed).filter("taken").select("doc_id", "source", "tokens", "finish")


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, other: float = OTHER, budget_share: float = BUDGET_SHARE, budget_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs that mix() takes, with docs' own columns.

    Equal rows (doc_id, source, text) stand next to each other in their source's order, so the budget can end between them
    once per source at most; there as many of them are taken as mix() takes, numbered in parallel by partition.
    """
    key = ["__doc", "__source", "__h"]
    rows = _ordered(docs, weights, other, budget_share, budget_tokens, seed).select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "source", "h"), key)], F.col("taken").cast("bigint").alias("t"))
    keys = cut(rows.groupBy(*key).agg(F.sum("t").alias("__m"), F.count("*").alias("__n")).filter("__m > 0"))
    marked = docs.select("*", *[c.alias(k) for c, k in zip(_identity(docs), key)])
    whole = marked.join(keys.filter("__m = __n"), key, "left_semi").select(docs.columns)
    split = keys.filter("__m < __n").drop("__n")
    if not split.limit(1).count():
        return whole
    copies = cut(marked.join(split, key).withColumn("__part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy(*key, "__part").orderBy(*key))
    ends = Window.partitionBy(*key).orderBy("__part")
    before = copies.groupBy(*key, "__part").agg(F.count("*").alias("__c")).withColumn("__before", F.sum("__c").over(ends) - F.col("__c")).drop("__c")
    some = copies.withColumn("__place", place).join(before, [*key, "__part"]).filter("__place + __before <= __m")
    return whole.union(some.select(docs.columns))
