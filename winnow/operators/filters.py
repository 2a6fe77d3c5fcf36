"""Gates and selections. Each takes and returns a DataFrame; `pos` names the column that holds the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import text as T


def score(name: str, scores: str = "cycle_scores") -> Column:
    """A component of the scores; a missing one counts 0."""
    return F.coalesce(F.col(f"{scores}.{name}").cast("double"), F.lit(0.0))


def cycle_pass(composite: float = 0.70, ar: float = 0.60, clip: float = 0.20, qr: float = 0.55, scores: str = "cycle_scores") -> Column:
    return F.col(scores).isNotNull() & (score("composite", scores) >= composite) & (score("ar", scores) >= ar) & (score("clip", scores) >= clip) & (score("qr", scores) >= qr)


def cycle_filter(df: DataFrame, **limits: float) -> DataFrame:
    return df.filter(cycle_pass(**limits))


def to_chat(df: DataFrame, question: str = "question", answer: str = "answer", image: str = "image_path") -> DataFrame:
    """df with messages and images: those that a row has where it has both, else the question, marked with its image, and the answer."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    messages = F.array(turn("user", F.concat(F.lit("<image>"), have(question))), turn("assistant", have(answer)))
    images = F.when(have(image) == "", F.array().cast("array<string>")).otherwise(F.array(have(image)))
    if "messages" in df.columns and "images" in df.columns:
        own = F.col("messages").isNotNull() & F.col("images").isNotNull()
        kept = F.transform("messages", lambda m: turn("", m["content"]).withField("role", m["role"]))
        messages, images = F.when(own, kept).otherwise(messages), F.when(own, F.col("images")).otherwise(images)
    return df.withColumns({"messages": messages, "images": images})


def export_chat(df: DataFrame, **limits: float) -> DataFrame:
    """Rows that pass the cycle filter, as chat records with what describes them."""
    return to_chat(cycle_filter(df, **limits)).select("messages", "images", "image_id", "question", "answer", "generation_model", "cycle_scores", score("composite").alias("cycle_score"))


def cycle_statistics(df: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: counts, share dropped, spread of the composite score, and the shares at or above five thresholds."""
    s = score("composite")
    aggs = [F.avg(s).alias("mean"), F.coalesce(F.stddev_pop(s), F.lit(0.0)).alias("std"), F.min(s).alias("min"), F.max(s).alias("max")]
    shares = [F.coalesce(F.avg((s >= t / 10).cast("double")), F.lit(0.0)).alias(f"at_{t}0") for t in range(5, 10)]
    one = df.agg(F.count("*").alias("total"), *aggs, *shares).crossJoin(kept.agg(F.count("*").alias("kept")))  # one row each
    return one.withColumn("drop_share", F.coalesce(F.try_divide(F.col("total") - F.col("kept"), F.col("total")), F.lit(0.0)))


def quality_gate(df: DataFrame, least_chars: int = 20, least_blur: float = 100.0, least_entropy: float = 3.0) -> DataFrame:
    """Texts, where there are any, of at least least_chars; images sharp and varied enough; unreadable images (null) go."""
    source = F.coalesce("source_text", F.lit(""))
    return df.filter(((source == "") | (F.length(T.strip(source)) >= least_chars)) & (F.col("blur") >= least_blur) & (F.col("entropy") >= least_entropy))


def size_gate(df: DataFrame, least_side: int = 224, most_ratio: float = 5.0) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return df.filter((F.least(w, h) >= least_side) & (F.greatest(w, h) <= most_ratio * F.least(w, h)))


def score_gate(df: DataFrame, column: str, least: float) -> DataFrame:
    return df.filter(F.col(column) >= least)


def head(df: DataFrame, n: int | None, pos: str = "pos") -> DataFrame:
    """The first n rows in order; all for 0 or None."""
    return df.orderBy(pos).limit(n) if n else df


def by_clip(df: DataFrame, least: float = 0.2, n: int | None = None, pos: str = "pos") -> DataFrame:
    """Rows whose CLIP score reaches least; beyond the budget n the best, of equals the earlier."""
    kept = df.filter(score("clip").isNotNull() & (F.col("cycle_scores.clip") >= least))
    return kept.orderBy(F.desc("cycle_scores.clip"), pos).limit(n) if n else kept


def by_length(df: DataFrame, low: int = 3, high: int = 300, n: int | None = None, pos: str = "pos", answer: str = "answer") -> DataFrame:
    return head(df.filter(F.length(T.strip(F.col(answer))).between(low, high)), n, pos)


def random_k(df: DataFrame, key: str, k: int | None = None, ratio: float = 0.5, n: int | None = None, seed: int = 0) -> DataFrame:
    """Exactly k rows (or max(1, ratio of all)), without replacement, the same for one seed: the least by md5(seed:key)."""
    if k is None:
        k = max(1, int(ratio * df.count()))
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(min(k, n) if n else k)


def grounded_scores_pass(least: float = 0.55, scores: str = "cycle_scores") -> Column:
    return (score("composite", scores) >= least) & (score("ar", scores) >= least) & (score("qr", scores) >= least)


def resolve_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def repeat_rows(df: DataFrame, n: int) -> DataFrame:
    """Every row n times, numbered by `copy`."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n > 0 else df.withColumn("copy", F.lit(1)).limit(0)


def cycle_assign(items: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """n rows (slot, and the columns of items): slot i holds item i modulo the number of items, in order."""
    if n <= 0:
        raise ValueError("n must be positive")
    from winnow.operators.order import numbered

    ranked = numbered(items, [F.col(pos)], "__at")
    size = items.count()
    if not size:
        raise ValueError("no items to assign")
    slots = items.sparkSession.range(n).withColumnRenamed("id", "slot").withColumn("__at", F.col("slot") % size + 1)
    return slots.join(ranked, "__at").drop("__at")


def alpaca(df: DataFrame, instruction: str, keep_instruction: bool = False) -> DataFrame:
    """(instruction, input, output) of rows that have both input and output, as text."""
    own = F.nullif(F.col("instruction").cast("string"), F.lit("")) if keep_instruction else F.lit(None).cast("string")
    return df.filter("input IS NOT NULL AND output IS NOT NULL").select(F.coalesce(own, F.lit(instruction)).alias("instruction"), F.col("input").cast("string").alias("input"), F.col("output").cast("string").alias("output"))
