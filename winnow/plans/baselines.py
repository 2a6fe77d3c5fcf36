"""Baselines, benchmarks and metrics under their names. Importing this module fills the registries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.operators import benchmarks as B
from winnow.operators import filters
from winnow.operators import metrics as M
from winnow.plans.registry import BASELINES, BENCHMARKS, METRICS

BASELINES.add("no_filter")(lambda df, n=None, **_: filters.head(df, n))
BASELINES.add("clip_only")(lambda df, threshold=0.2, n=None, **_: filters.by_clip(df, threshold, n))
BASELINES.add("length_heuristic")(lambda df, low=3, high=300, n=None, **_: filters.by_length(df, low, high, n))
BASELINES.add("random_k")(lambda df, k=None, ratio=0.5, seed=0, n=None, **_: filters.random_k(df, "pos", k, ratio, n, seed))
BASELINES.add("external_dataset")(lambda df, n=None, **_: filters.head(df, n))


@BASELINES.add("ours")
def _ours(df: DataFrame, n: int | None = None, **places) -> DataFrame:
    """The round's, the filtered or the pool's file, read from its place; the pool given is only where the session comes from."""
    from winnow.plans.rounds import ours

    rows = ours(df.sparkSession, **places)
    return rows.limit(n) if n else rows


def _scores(scorer: Callable[..., DataFrame], main: str) -> Callable[[DataFrame], DataFrame]:
    """The scorer's one row in the shape of the others: category "all", n, score, and all of its values beside them."""

    def score(df: DataFrame) -> DataFrame:
        one = scorer(df)
        kept = [c for c in one.columns if c not in ("n", "score")]
        return one.select(F.lit("all").alias("category"), "n", F.col(main).alias("score"), *kept)

    return score


BENCHMARKS.add("gqa")(B.exact_match)
BENCHMARKS.add("mmbench")(B.multiple_choice)
BENCHMARKS.add("docvqa")(B.anls)
BENCHMARKS.add("vqav2")(_scores(B.vqa, "score"))
BENCHMARKS.add("pope")(_scores(B.yes_no, "accuracy"))
BENCHMARKS.add("hallusion")(_scores(B.hallusion, "a_acc"))


def qa(df: DataFrame) -> DataFrame:
    """df with question, answer and image_path from its own fields or else from its messages and images."""
    have = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    turns = have("messages", "array<struct<role string, content string>>")
    return df.withColumns({"question": T.sample_question(have("question", "string"), turns), "answer": T.sample_answer(have("answer", "string"), turns), "image_path": T.sample_image(have("image_path", "string"), have("images", "array<string>"))})


def _value(df: DataFrame):
    return df.first()[0]


@METRICS.add("diversity")
def diversity(df: DataFrame, sample: int = 200, seed: int = 0, pos: str = "pos") -> dict:
    rows = qa(df)
    out: dict = {"num_samples": rows.count()}
    for column, short in (("question", "q"), ("answer", "a")):
        out |= {f"distinct_{r['n']}_{short}": r["distinct_share"] for r in M.distinct_n(rows, column).collect()}  # three rows
        out[f"type_token_ratio_{short}"] = out[f"distinct_1_{short}"]
        out[f"{column}_length_std"] = M.length_stats(rows, column).first()["std"]
        out[f"self_bleu_4_{short}"] = _value(M.self_bleu(rows, column, pos, sample, seed))
    both = rows.withColumn("__both", T.strip(F.concat_ws(" ", "question", "answer")))
    out["mtld_mean"] = _value(M.mtld(both, "__both"))
    if "average_hash" in df.columns:
        out["image_phash_unique_ratio"] = _value(M.unique_ratio(df))
    return out


@METRICS.add("linguistic")
def linguistic(df: DataFrame, faulty: Callable | None = None) -> dict:
    """faulty: a grammar checker over batches of texts, which the caller brings; without it no error rate is given."""
    rows = qa(df)
    out: dict = {"num_samples": rows.count()}
    for column, short in (("question", "q"), ("answer", "a")):
        out[f"{column}_length"] = M.length_stats(rows, column).first().asDict()
        out[f"template_repeat_rate_{short}"] = _value(M.template_repeats(rows, column))
    out["yes_no_answer_rate"], out["sentence_shape_rate_a"] = _value(M.yes_no_rate(rows)), _value(M.sentence_shape(rows))
    if faulty is not None:
        out["grammar_error_rate_a"] = _value(M.grammar_error_rate(rows, faulty))
    return out


@METRICS.add("hallucination")
def hallucination(df: DataFrame, presence: DataFrame | None = None, pos: str = "pos") -> dict:
    """presence (image_path, noun, present): what a detector saw; without it only the share of low alignment is given."""
    rows = qa(df)
    out: dict = {}
    if presence is not None:
        one, per = M.chair(rows, presence, pos)
        out |= one.first().asDict() | {"per_noun": {r["noun"]: (r["total"], r["hallucinated"]) for r in per.orderBy(F.desc("hallucinated"), "noun").limit(50).collect()}}
    if "clip" in df.columns:
        out |= M.low_alignment(rows).first().asDict()
    return out


METRICS.add("cycle_score_stats")(M.component_stats)
METRICS.add("qa_type_stats")(lambda df: M.type_distribution(qa(df)))
METRICS.add("pass_rates")(M.pass_rates)
METRICS.add("alignment")(M.alignment)
