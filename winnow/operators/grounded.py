"""Verdicts of an external verifier: parsing, normalising, rule-based post-checks, keep flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.operators.filters import grounded_scores_pass

PROMPT_VERSION = "strict_v2"
ERRORS = ("contradiction", "counting_error", "diagram_error", "math_error", "none", "other", "table_error", "uncertain", "unsupported_inference")


def verdict_object(raw: Column) -> Column:
    """The JSON object of a verifier's output as a variant: the text without code fences, else what lies between its outer
    braces; null where neither is an object."""
    t = F.regexp_replace(F.regexp_replace(T.strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    whole, inner = F.try_parse_json(t), F.try_parse_json(F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit("")))
    usable = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    return F.when(whole.isNotNull(), usable(whole)).otherwise(usable(inner))


def parsed(df: DataFrame, raw: str = "raw_output", version: str | None = PROMPT_VERSION) -> DataFrame:
    """df with supported, error_type, reason, corrected_answer, verifier_version. What can't be parsed is not supported."""
    v = df.withColumn("__v", verdict_object(F.col(raw)))
    said = F.try_variant_get("__v", "$.supported", "string")
    kind = F.schema_of_variant(F.try_variant_get("__v", "$.supported", "variant"))
    ok = F.coalesce(F.when(kind == "STRING", F.lower(T.strip(said)) == "true").when(kind == "BOOLEAN", said == "true").when(kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE"), said.cast("double") != 0).otherwise(F.length(said) > 2), F.lit(False))
    error = T.strip(F.coalesce(F.try_variant_get("__v", "$.error_type", "string"), F.when(F.col("supported"), "none").otherwise("other")))
    out = v.withColumn("supported", F.col("__v").isNotNull() & ok).withColumn("error_type", error)
    out = out.withColumn("error_type", F.when(F.col("__v").isNull() | ~F.col("error_type").isin(*ERRORS) | (~F.col("supported") & (F.col("error_type") == "none")), "other").otherwise(F.col("error_type")))
    reason = F.when(F.col("__v").isNull(), "Could not parse verifier JSON").otherwise(T.strip(F.coalesce(F.try_variant_get("__v", "$.reason", "string"), F.lit(""))))
    return out.withColumn("reason", reason).withColumn("corrected_answer", F.try_variant_get("__v", "$.corrected_answer", "string")).withColumn("verifier_version", F.lit(version or "legacy")).drop("__v")


def post_checked(df: DataFrame) -> DataFrame:
    """df with the numbers of answer, reason and correction, risk types, post_supported, manual_review and why."""
    n = df
    for name, source in (("answer_numbers", "answer"), ("reason_numbers", "reason"), ("corrected_answer_numbers", "corrected_answer")):
        n = n.withColumn(name, T.numbers(F.col(source)))
    n = n.withColumn("risk_types", T.risk_types(F.col("question"), F.col("answer")))
    has = lambda c: F.size(c) > 0
    apart = lambda a, b: has(a) & has(b) & ~F.arrays_overlap(a, b)
    corrected = F.coalesce("corrected_answer", F.lit("")) != ""
    wrong = F.col("error_type") != "none"
    reason_gap, corrected_gap = apart("answer_numbers", "reason_numbers"), apart("answer_numbers", "corrected_answer_numbers")
    doubt = F.col("supported") & T.contradicts(F.col("reason"))
    stale = has("risk_types") & (F.col("verifier_version") != PROMPT_VERSION)
    count = F.array_contains("risk_types", "counting")
    why = [(corrected, "verifier_provided_corrected_answer"), (wrong, "verifier_error_type_not_none"), (reason_gap, "answer_reason_numeric_mismatch"), (corrected_gap, "answer_corrected_numeric_mismatch"), (doubt, "supported_reason_contains_contradiction_language"), (stale, "high_risk_not_verified_by_strict_v2"), (count, "requires_independent_count_check")]
    n = n.withColumn("review_reasons", F.array_compact(F.array(*[F.when(c, F.lit(w)) for c, w in why])))
    n = n.withColumn("post_supported", F.col("supported") & ~corrected & ~wrong & ~corrected_gap).withColumn("manual_review", reason_gap | corrected_gap | doubt | stale | count).withColumn("requires_independent_count_check", count)
    return n.withColumn("high_risk_unverified", has("risk_types") & (~F.col("post_supported") | F.col("manual_review")))


def keep_flags(df: DataFrame, least: float = 0.55) -> DataFrame:
    scores = grounded_scores_pass(least)
    good = F.col("post_supported") & (F.col("error_type") == "none") & F.col("corrected_answer").isNull() & ~F.col("manual_review") & ~F.array_contains("risk_types", "inference") & ~F.col("requires_independent_count_check")
    return df.withColumn("keep_score_grounded", scores & F.col("supported")).withColumn("keep_final", scores & good)
