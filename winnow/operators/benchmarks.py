"""Benchmark scorers: predictions joined to gold by example, one row of scores (and one per category)."""

from __future__ import annotations

from collections.abc import Sequence

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import text as T


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def attach_answers(questions: DataFrame, annotations: DataFrame, pos: str = "pos", key: str = "question_id", ties: Sequence[str] = ()) -> DataFrame:
    """Questions with the last annotation of their id; questions without one go. Of annotations at one pos the first by ties is taken."""
    w = Window.partitionBy(key).orderBy(F.desc(pos), *ties)
    last = annotations.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", pos, *ties)
    return questions.join(last, key)


def with_totals(df: DataFrame, value: Column, category: str = "category") -> DataFrame:
    """(category, n, score): per category and for all ("all"); an empty category belongs to "all" only."""
    rows = df.select(F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("all")).alias("category"), value.cast("double").alias("v"))
    each = F.when(F.col("category") == "all", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.col("category")))
    return rows.select(F.explode(each).alias("category"), "v").groupBy("category").agg(F.count("*").alias("n"), F.avg("v").alias("score"))


def vqa(df: DataFrame, prediction: str = "prediction", golds: str = "golds") -> DataFrame:
    """Mean of min(matching golds / 3, 1)."""
    p = T.normalise_answer(F.coalesce(F.col(prediction), F.lit("")))
    hits = F.size(F.filter(F.transform(F.col(golds), T.normalise_answer), lambda g: g == p))
    return df.agg(F.count("*").alias("n"), _or0(F.avg(F.least(hits / 3, F.lit(1.0)))).alias("score"))


def exact_match(df: DataFrame, prediction: str = "prediction", gold: str = "gold", category: str = "category") -> DataFrame:
    same = T.normalise_answer(T.first_line(F.coalesce(F.col(prediction), F.lit("")))) == T.normalise_answer(F.col(gold))
    return with_totals(df, same, category)


def multiple_choice(df: DataFrame, prediction: str = "prediction", gold: str = "gold", choices: str = "choices", category: str = "category") -> DataFrame:
    return with_totals(df, F.coalesce(T.choice_letter(F.col(prediction), F.col(choices)) == F.col(gold), F.lit(False)), category)


def yes_no(df: DataFrame, prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """Accuracy, precision, recall, F1, share of yes and of what can't be read, which counts as no."""
    said = T.pope_yes_no(F.col(prediction))
    rows = df.select(F.coalesce(said, F.lit("no")).alias("p"), (F.lower(T.strip(F.col(gold)))).alias("g"), said.isNull().alias("u"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    p, g = F.col("p") == "yes", F.col("g") == "yes"
    one = rows.agg(F.count("*").alias("n"), n(p & g).alias("tp"), n(p & ~g).alias("fp"), n(~p & g).alias("fn"), n(~p & ~g).alias("tn"), n(F.col("u")).alias("u"))
    least1 = lambda c: F.greatest(c, F.lit(1))
    one = one.withColumn("accuracy", (F.col("tp") + F.col("tn")) / least1(F.col("n"))).withColumn("precision", F.col("tp") / least1(F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / least1(F.col("tp") + F.col("fn")))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))
    return one.withColumn("f1", f1).withColumn("yes_ratio", (F.col("tp") + F.col("fp")) / least1(F.col("n"))).withColumn("unparseable_ratio", F.col("u") / least1(F.col("n"))).drop("u")


def anls(df: DataFrame, prediction: str = "prediction", golds: str = "golds", least: float = 0.5, category: str = "category") -> DataFrame:
    """Best similarity over the golds, 0 below `least`."""
    best = F.coalesce(F.array_max(F.transform(F.col(golds), lambda g: T.nls(F.coalesce(F.col(prediction), F.lit("")), g))), F.lit(0.0))
    return with_totals(df, F.when(best < least, 0.0).otherwise(best), category)


def hallusion(df: DataFrame, prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """Shares right of answers, of question sets and of figures; all rows without a figure are one figure."""
    right = F.coalesce(T.hallusion_yes_no(F.col(prediction)) == T.hallusion_gold(F.col(gold)), F.lit(False))
    rows = df.select(right.alias("ok"), F.coalesce(F.nullif(F.col("set_id").cast("string"), F.lit("")), F.col("question_id").cast("string")).alias("s"), F.coalesce(F.col("figure_id").cast("string"), F.lit("")).alias("f"))
    group = lambda k, name: rows.groupBy(k).agg(F.bool_and("ok").alias("ok")).agg(_or0(F.avg(F.col("ok").cast("double"))).alias(name))
    return rows.agg(F.count("*").alias("n"), _or0(F.avg(F.col("ok").cast("double"))).alias("a_acc")).crossJoin(group("s", "q_acc")).crossJoin(group("f", "f_acc"))  # one row each


def mmlu(df: DataFrame, prediction: str = "prediction", answer: str = "answer") -> DataFrame:
    right = T.mmlu_letter(F.col(prediction)) == F.get(F.array(*[F.lit(x) for x in "ABCD"]), F.col(answer))
    return df.agg(F.count("*").alias("n"), _or0(100 * F.avg(F.coalesce(right, F.lit(False)).cast("double"))).alias("accuracy"))


def prompt(kind: str, question: Column, hint: Column | None = None, choices: Column | None = None) -> Column:
    """The text that a benchmark's model is asked."""
    if kind == "mmbench":
        lines = F.array_join(F.transform(F.array_sort(F.map_keys(choices)), lambda k: F.concat(k, F.lit(". "), choices[k])), "\n")
        return F.concat(F.coalesce(F.concat(F.nullif(hint, F.lit("")), F.lit("\n")), F.lit("")), question, F.lit("\n"), lines, F.lit("\nGive the letter of the right option only."))
    if kind == "mmlu":
        return F.concat(question, *[F.concat(F.lit(f"\n{x}. "), F.get(choices, F.lit(k))) for k, x in enumerate("ABCD")], F.lit("\nAnswer:"))
    ends = {"vqav2": "\nA word or a short phrase is enough.", "gqa": "\nOne word or phrase.", "pope": "\nSay yes or no.", "docvqa": "\nQuote the document.", "hallusion": "\nSay yes or no."}
    return F.concat(question, F.lit(ends[kind]))
