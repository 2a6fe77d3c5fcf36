"""Queries over the test tables, one per operator, with the SQL that gives the same rows.

The tables hold no images, questions or scores: pairs() makes samples of conversations (a user's turn and the reply), with a
question form chosen by conv_id and scores from md5, which SQL repeats. All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.operators import analysis, benchmarks, dedup, extract, filters, grounded, metrics, mixing
from winnow.operators.order import shared_dir
from winnow.plans import generation
from winnow.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FORMS = ("How many ", "Why ", "What is to the left of ", "What does the sign say near ", "What is the person doing with ", "Which items ")


def query(sql: str | None = None):
    def take(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            fix = {"int": lambda c: c.cast("bigint"), "double": lambda c: F.round(c, 6)}
            return df.select(*[fix[t](F.col(f"`{c}`")).alias(c) if t in fix else F.col(f"`{c}`") for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(tag: str, key: Column) -> Column:
    """A number from 0 to 1 that md5 gives a key."""
    return F.conv(F.left(F.md5(F.concat(F.lit(f"{tag}:"), key.cast("string"))), F.lit(8)), 16, 10).cast("double") / 4294967295.0


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).filter("role = 'user' AND next_role = 'assistant'")
    pos = (F.col("conv_id") * 100000 + F.col("turn")).cast("bigint")
    form = F.element_at(F.array(*[F.lit(x) for x in FORMS]), (F.col("conv_id") % 6 + 1).cast("int"))
    out = rows.select(pos.alias("pos"), F.concat(F.lit("img"), (F.col("conv_id") % 97).cast("string")).alias("image_id"), F.concat(form, "text", F.lit("?")).alias("question"), "answer")
    out = out.withColumn("image_path", F.concat("image_id", F.lit(".jpg"))).withColumn("generation_model", F.lit("m"))
    s = [share(t, F.col("pos")) for t in ("ar", "clip", "qr", "ppl")]
    return out.withColumn("cycle_scores", metrics.composite(*s)).withColumn("key", T.sample_key(F.col("image_id"), F.col("question")))


_H = lambda tag, key="pos": f"(CAST(('0x' || left(md5('{tag}:' || {key}), 8)) AS BIGINT) / 4294967295.0)"
_FORM = "CASE conv_id % 6 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(FORMS)) + " END"
_SP = r"[\s\x0b]+"
_NORM = lambda c: f"regexp_replace(lower(regexp_replace({c}, '^{_SP}|{_SP}$', '', 'g')), '{_SP}', ' ', 'g')"
_STRIP = lambda c: f"regexp_replace({c}, '^{_SP}|{_SP}$', '', 'g')"
_WORDS = lambda c: rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"


#: The SQL's own word lists, written out so that a wrong one on the other side shows.
_TYPES_SQL = {
    "counting": (["number of", "how many", "count of"], [r"\bhow\s+many\b"]),
    "reasoning": (["why", "what would happen", "how does", "explain", "compare"], [r"^\s*why\b", r"\bhow\s+does\b"]),
    "spatial": (["to the right", "to the left", "next to", "in front of", "between", "below", "behind", "above"], [r"\bwhere\b.*\bis\b"]),
    "text_ocr": (["written", "word", "text", "sign", "say", "letter", "label", "caption"], [r"\bwhat\b.*\b(text|sign|label)\b.*\bsay"]),
    "actions": (["what is", "what are", "doing"], [r"\bwhat\s+(is|are)\b.*\bdoing\b"]),
    "objects": (["which items", "what things", "what objects", "what items", "name the", "list the"], [r"\bwhat\b.*\b(thing|item|object)s?\b"]),
}
_RISKS_SQL = {
    "counting": ["total number", "number of", "how many", "counts", "count"],
    "math": ["total", "ratio", "probability", "percentage", "percent", "kinetic energy", "difference", "compare", "%"],
    "diagram": ["table", "punnett", "phenotype", "lattice", "genotype", "food web", "diagram", "chart", "allele"],
    "inference": ["why", "used for", "use for", "type of", "purpose", "might", "likely", "kind of", "indicating", "habitat", "function", "environment", "cause"],
}
_STOP_SQL = "yes with which where when what visible under those this they these there them their that some shown showing scene says said picture photo over onto not none no much most more many less least into image have from done doing does between below being been around above about".split()


def _type_sql(c: str) -> str:
    cases = " ".join("WHEN " + " OR ".join([f"contains({c}, '{w}')" for w in words] + [f"regexp_matches({c}, '{p}')" for p in patterns]) + f" THEN '{name}'" for name, (words, patterns) in _TYPES_SQL.items())
    return f"CASE {cases} ELSE 'objects' END"


P = rf"""WITH p0 AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p1 AS (
  SELECT CAST(conv_id * 100000 + turn AS BIGINT) AS pos, 'img' || (conv_id % 97) AS image_id, {_FORM} || text || '?' AS question, answer FROM p0 WHERE role = 'user' AND next_role = 'assistant'),
p2 AS (SELECT *, {_H('ar')} AS ar0, {_H('clip')} AS clip0, {_H('qr')} AS qr0, {_H('ppl')} AS ppl0 FROM p1),
p AS (
  SELECT pos, image_id, image_id || '.jpg' AS image_path, question, answer, round(ar0, 4) AS ar, round(clip0, 4) AS clip, round(qr0, 4) AS qr, round(ppl0, 4) AS ppl,
    round(0.4 * ar0 + 0.25 * clip0 + 0.25 * qr0 + 0.1 * ppl0, 4) AS composite, md5(image_id || '||' || {_NORM('question')}) AS key, {_type_sql('lower(question)')} AS qa_type FROM p2)
"""
_PASS = "composite >= 0.7 AND ar >= 0.6 AND clip >= 0.2 AND qr >= 0.55"


# the flagship: from raw turns to quality by question type


@query(P + f", k AS (SELECT * FROM p WHERE {_PASS}) SELECT qa_type, count(*) AS n, round(avg(composite), 6) AS mean_composite, round(avg(CASE WHEN composite >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM k GROUP BY qa_type")
def m0_cycle_pipeline(spark, d):
    return metrics.by_type(filters.cycle_filter(pairs(spark, d)))


# filters and projections


@query(P + f"SELECT pos, composite FROM p WHERE {_PASS}")
def f1_cycle_filter(spark, d):
    return filters.cycle_filter(pairs(spark, d)).select("pos", "cycle_scores.composite")


@query(P + f"SELECT '<image>' || question AS user_content, answer AS reply, image_path AS image, image_id, round(composite, 6) AS cycle_score FROM p WHERE {_PASS}")
def f2_export_chat(spark, d):
    e = filters.export_chat(pairs(spark, d))
    return e.select(F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("reply"), F.col("images")[0].alias("image"), "image_id", "cycle_score")


@query(P + "SELECT pos FROM p WHERE composite >= 0.55 AND ar >= 0.55 AND qr >= 0.55")
def f3_grounded_scores(spark, d):
    return pairs(spark, d).filter(filters.grounded_scores_pass()).select("pos")


def verdicts(spark, d):
    """Raw verifier outputs of six kinds by pos."""
    p = pairs(spark, d).withColumn("answer", F.concat(F.lit("It shows "), (F.col("pos") % 7).cast("string"), F.lit(" things")))
    p = p.withColumn("question", F.element_at(F.array(*[F.lit(x) for x in ("Which colour is it?", "How many are there?", "Why is it so?")]), (F.floor(F.col("pos") / 100000) % 3 + 1).cast("int")))
    k = F.floor(F.col("pos") / 100000) % 6
    kinds = ('{"supported": true, "error_type": "none", "reason": "seen"}', '```json\n{"supported": "True", "error_type": "none", "reason": "it is wrong"}\n```', 'Verdict: {"supported": false, "error_type": "none"} end', "no json here", '{"supported": true, "error_type": "odd", "reason": ""}', '{"supported": true, "error_type": "none", "reason": "there are 9", "corrected_answer": ""}')
    raw = F.lit(None).cast("string")
    for i, x in reversed(list(enumerate(kinds))):
        raw = F.when(k == i, F.lit(x)).otherwise(raw)
    return p.withColumn("raw_output", raw)


_V = P + """, v AS (SELECT *, (pos // 100000) % 6 AS k, (pos // 100000) % 3 AS q, (pos % 7) AS num FROM p),
w AS (SELECT *, k IN (0, 1, 4, 5) AS supported, CASE WHEN k IN (0, 1, 5) THEN 'none' ELSE 'other' END AS error_type, k = 5 AND num <> 9 AS gap, k = 1 AS doubt, q = 1 AS counting, q = 2 AS inference FROM v),
x AS (SELECT *, supported AND error_type = 'none' AS post_supported, gap OR doubt OR counting AS manual_review FROM w)
"""


@query(_V + "SELECT pos, supported, error_type, post_supported, manual_review, composite >= 0.55 AND ar >= 0.55 AND qr >= 0.55 AND supported AS keep_score_grounded, composite >= 0.55 AND ar >= 0.55 AND qr >= 0.55 AND post_supported AND NOT manual_review AND NOT inference AND k <> 5 AS keep_final FROM x")
def f4_keep_flags(spark, d):
    got = grounded.keep_flags(grounded.post_checked(grounded.parsed(verdicts(spark, d))))
    return got.select("pos", "supported", "error_type", "post_supported", "manual_review", "keep_score_grounded", "keep_final")


@query(_V + "SELECT pos, CAST(gap AS INT) + CAST(error_type <> 'none' AS INT) + CAST(doubt AS INT) + CAST(counting AS INT) AS n_reasons, (counting OR inference) AND (NOT post_supported OR manual_review) AS high_risk_unverified FROM x".replace("CAST(gap AS INT)", "CAST(gap AS BIGINT)"))
def t22_post_checks(spark, d):
    got = grounded.post_checked(grounded.parsed(verdicts(spark, d)))
    return got.select("pos", F.size("review_reasons").alias("n_reasons"), "high_risk_unverified")


@query(f"SELECT doc_id FROM documents WHERE (text = '' OR len({_STRIP('text')}) >= 20) AND 200 * {_H('blur', 'doc_id')} >= 100 AND 8 * {_H('entropy', 'doc_id')} >= 3")
def f5_quality_gate(spark, d):
    docs = table(spark, d, "documents").withColumn("source_text", F.col("text")).withColumn("blur", 200 * share("blur", F.col("doc_id"))).withColumn("entropy", 8 * share("entropy", F.col("doc_id")))
    return filters.quality_gate(docs).select("doc_id")


@query("SELECT p_partkey FROM (SELECT p_partkey, 100 + (p_partkey * 37) % 900 AS w, 100 + (p_partkey * 91) % 1900 AS h FROM part) WHERE least(w, h) >= 224 AND greatest(w, h) <= 5 * least(w, h)")
def f6_size_gate(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (100 + F.col("p_partkey") * 37 % 900).alias("width"), (100 + F.col("p_partkey") * 91 % 1900).alias("height"))
    return filters.size_gate(rows).select("p_partkey")


@query(P + "SELECT pos FROM p WHERE clip >= 0.15")
def f7_clip_prefilter(spark, d):
    return filters.score_gate(pairs(spark, d).select("pos", "cycle_scores.clip"), "clip", 0.15).select("pos")


@query(P + "SELECT pos FROM p ORDER BY pos LIMIT 100")
def f8_no_filter(spark, d):
    return filters.head(pairs(spark, d), 100).select("pos")


@query(P + "SELECT pos, round(clip, 6) AS clip FROM p WHERE clip >= 0.2 ORDER BY clip DESC, pos LIMIT 100")
def f9_clip_only(spark, d):
    return filters.by_clip(pairs(spark, d), 0.2, 100).select("pos", "cycle_scores.clip")


@query(P + f"SELECT pos FROM p WHERE len({_STRIP('answer')}) BETWEEN 3 AND 300")
def f10_length_heuristic(spark, d):
    return filters.by_length(pairs(spark, d)).select("pos")


@query(P + "SELECT pos FROM p ORDER BY md5('0:' || pos), pos LIMIT 50")
def f11_random_k(spark, d):
    return filters.random_k(pairs(spark, d), "pos", k=50).select("pos")


@query(P + "SELECT pos, CAST(copy AS BIGINT) AS copy FROM p, generate_series(1, 3) g(copy)")
def f18_repeat_rows(spark, d):
    return filters.repeat_rows(pairs(spark, d), 3).select("pos", "copy")


@query("SELECT CAST(r AS BIGINT) AS slot, n_nationkey FROM range(1000) t(r) JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation) ON r % n = i")
def f19_cycle_assign(spark, d):
    return filters.cycle_assign(table(spark, d, "nation").select("n_nationkey"), 1000, "n_nationkey")


@query(P + f", k AS (SELECT count(*) AS kept FROM p WHERE {_PASS}) SELECT count(*) AS total, any_value(kept) AS kept, round((count(*) - any_value(kept)) / count(*), 6) AS drop_share, round(avg(composite), 6) AS mean, round(stddev_pop(composite), 6) AS std, round(min(composite), 6) AS min, round(max(composite), 6) AS max, " + ", ".join(f"round(avg(CASE WHEN composite >= 0.{t} THEN 1.0 ELSE 0.0 END), 6) AS at_{t}0" for t in range(5, 10)) + " FROM p, k")
def f20_cycle_statistics(spark, d):
    p = pairs(spark, d)
    return filters.cycle_statistics(p, filters.cycle_filter(p))


@query(P + "SELECT DISTINCT 'x' AS instruction, question AS input, answer AS output FROM p".replace("DISTINCT ", ""))
def f16_alpaca(spark, d):
    return filters.alpaca(pairs(spark, d).select(F.lit(None).cast("string").alias("instruction"), F.col("question").alias("input"), F.col("answer").alias("output")), "x")


# deduplication


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(coalesce(text, ''))")
def d1_keyed_dedup(spark, d):
    return dedup.keep_first(table(spark, d, "documents"), F.md5(F.coalesce("text", F.lit(""))), "doc_id").select("doc_id")


@query(P + "SELECT pos, key FROM p")
def d2_sample_key(spark, d):
    return pairs(spark, d).select("pos", "key")


@query(f"WITH s AS (SELECT doc_id, string_split({_STRIP('text')}, '') AS c FROM documents) SELECT doc_id, CASE WHEN len(c) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) END AS n_shingles FROM s")
def d3_shingles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.shingles(F.col("text"))).alias("n_shingles"))


@query()
def d4_minhash_signatures(spark, d):
    s = dedup.signatures(table(spark, d, "documents"), "doc_id")
    return s.select(F.col("id").alias("doc_id"), F.array_min("signature").alias("least"), F.xxhash64("signature").alias("digest"))


@query()
def d6_text_dedup(spark, d):
    return dedup.text_dedup(table(spark, d, "documents"), "doc_id").select("doc_id")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(bit_count(xor(a.n_nationkey * 7919, b.n_nationkey * 7919)) AS BIGINT) AS bits FROM nation a, nation b")
def d8_hamming(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    x, y = n.alias("x"), n.alias("y")
    return x.crossJoin(y).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), dedup.hamming(F.col("x.k") * 7919, F.col("y.k") * 7919).alias("bits"))  # 25 rows


def hashes(spark, d):
    """A 64-bit hash for each vector: the signs of its elements."""
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda t, x: t.bitwiseOR(x))
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("pos"), bits.alias("phash"))


@query()
def d9_image_dedup(spark, d):
    return dedup.image_dedup(hashes(spark, d)).select("pos")


@query()
def d10_composed_cleaning(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("pos"), F.col("text").alias("source_text"), F.lit(200.0).alias("blur"), F.lit(7.0).alias("entropy"))
    both = docs.join(hashes(spark, d), "pos", "left").withColumn("phash", F.coalesce("phash", F.xxhash64("pos")))
    return dedup.clean(both)[0].select("pos")


@query("SELECT round(count(DISTINCT l_partkey) / count(*), 6) AS unique_ratio FROM lineitem")
def d11_unique_ratio(spark, d):
    return metrics.unique_ratio(table(spark, d, "lineitem"), "l_partkey")


# joins


@query("WITH l AS (SELECT l_orderkey, max_by(l_comment_key, l_linenumber) AS last FROM (SELECT l_orderkey, l_linenumber, l_partkey AS l_comment_key FROM lineitem) GROUP BY l_orderkey) SELECT o_orderkey, last FROM orders JOIN l ON o_orderkey = l_orderkey")
def j1_attach_answers(spark, d):
    """Line numbers repeat within an order; of several that are last, the table's first counts, as with max_by."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    notes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("last"), *at)
    return benchmarks.attach_answers(table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id")), notes, ties=("file", "row")).select(F.col("question_id").alias("o_orderkey"), "last")


@query(P + "SELECT a.pos AS pos, b.pos AS next_pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM p) a JOIN (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS n FROM p) b USING (n)")
def j2_positional_join(spark, d):
    from winnow.operators.order import numbered

    n = numbered(pairs(spark, d).select("pos"), [F.col("pos")])
    return n.join(n.select(F.col("pos").alias("next_pos"), (F.col("n") - 1).alias("n")), "n").select("pos", "next_pos")


# metrics


def _types(spark, d):
    return metrics.type_distribution(pairs(spark, d))


_DIST = P + ", t AS (SELECT unnest(['objects', 'spatial', 'actions', 'counting', 'text_ocr', 'reasoning']) AS qa_type), dist AS (SELECT t.qa_type, count(pos) AS n, count(pos) / (SELECT count(*) FROM p) AS share FROM t LEFT JOIN p USING (qa_type) GROUP BY t.qa_type) "
_DIST2 = _DIST + ", dist2 AS (SELECT t.qa_type, count(pos) / (SELECT count(*) FROM p WHERE ar >= 0.5) AS share FROM t LEFT JOIN (SELECT * FROM p WHERE ar >= 0.5) USING (qa_type) GROUP BY t.qa_type) "


@query(_DIST + "SELECT qa_type, n, round(share, 6) AS share FROM dist")
def a1_type_distribution(spark, d):
    return _types(spark, d)


@query(_DIST + "SELECT round(-sum(CASE WHEN share > 0 THEN share * ln(share) END) / ln(6), 6) AS diversity FROM dist")
def a2_type_diversity(spark, d):
    return metrics.type_diversity(_types(spark, d))


_LONG = P + ", l AS (SELECT unnest(['ar', 'clip', 'qr', 'ppl', 'composite']) AS component, unnest([ar, clip, qr, ppl, composite]) AS value FROM p) "


@query(_LONG + "SELECT component, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM l GROUP BY component")
def a3_score_summary(spark, d):
    return metrics.score_summary(pairs(spark, d))


@query(P + ", c AS (SELECT key, pos, composite AS score, pos % 200000 < 100000 AS new FROM p), o AS (SELECT key, pos, score, 0 AS isnew, 0 AS round_added FROM c WHERE NOT new UNION ALL SELECT key, pos, score, 1, 3 FROM c WHERE new AND score >= 0.55), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, isnew, pos) AS n, min((isnew, pos)) OVER (PARTITION BY key) AS first FROM o) SELECT key, pos, round(score, 6) AS score, CAST(round_added AS BIGINT) AS round_added FROM r WHERE n = 1 ORDER BY r.score DESC, first, key LIMIT 200")
def a4_pool_upsert(spark, d):
    p = pairs(spark, d).select("key", "pos", F.col("cycle_scores.composite").alias("score"))
    new = F.col("pos") % 200000 < 100000
    return mixing.upsert_pool(p.filter(~new).withColumn("round_added", F.lit(0)), p.filter(new), 3, 0.55, 200)


@query(_DIST2 + "SELECT round(sum(abs(a.share - b.share)) / 2, 6) AS drift FROM dist a JOIN dist2 b USING (qa_type)")
def a5_drift(spark, d):
    p = pairs(spark, d)
    return metrics.drift(metrics.type_distribution(p), metrics.type_distribution(p.filter("cycle_scores.ar >= 0.5")))


@query(_LONG + ", r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY value) AS i, count(*) OVER (PARTITION BY component) AS n FROM l), q AS (SELECT unnest([25, 50, 75, 90, 95, 99]) AS percent) SELECT component, CAST(percent AS BIGINT) AS percent, round(value, 6) AS value FROM r, q WHERE i = round_even(percent / 100 * (n - 1), 0) + 1")
def a7_percentiles(spark, d):
    return metrics.percentiles(pairs(spark, d))


@query(P + ", r AS (SELECT unnest(['ar', 'clip', 'qr', 'ppl', 'composite']) AS x, unnest([ar, clip, qr, ppl, composite]) AS xv, pos FROM p) SELECT a.x AS x, b.x AS y, round(corr(a.xv, b.xv), 6) AS r FROM r a JOIN r b USING (pos) GROUP BY ALL")
def a8_pearson(spark, d):
    return metrics.pearson(pairs(spark, d))


@query(_LONG + ", e AS (SELECT component, min(value) AS lo, (max(value) - min(value)) / 50 AS w FROM l GROUP BY component) SELECT component, CAST(least(floor((value - lo) / w), 49) AS BIGINT) AS bin, count(*) AS n FROM l JOIN e USING (component) GROUP BY ALL")
def a9_histogram(spark, d):
    return metrics.histogram(pairs(spark, d))


@query(P + ", t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS t) SELECT format('{:.2f}', CAST(t AS DOUBLE)) AS threshold, round(avg(CASE WHEN composite >= t THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM p, t GROUP BY t")
def a10_pass_rates(spark, d):
    return metrics.pass_rates(pairs(spark, d))


@query(P + "SELECT qa_type, count(*) AS n, round(avg(composite), 6) AS mean_composite, round(avg(CASE WHEN composite >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM p GROUP BY qa_type")
def a11_by_type(spark, d):
    return metrics.by_type(pairs(spark, d))


@query(_DIST + "SELECT qa_type, n, round(share, 6) AS share FROM dist WHERE share < 0.1667")
def a12_under_represented(spark, d):
    return metrics.under_represented(_types(spark, d), 0.1667)


@query(_DIST2 + "SELECT round(sum(CASE WHEN a.share > 0 THEN a.share * ln(a.share / ((a.share + b.share) / 2)) ELSE 0 END + CASE WHEN b.share > 0 THEN b.share * ln(b.share / ((a.share + b.share) / 2)) ELSE 0 END) / 2, 6) AS js FROM dist a JOIN dist2 b USING (qa_type)")
def a13_js_divergence(spark, d):
    p = pairs(spark, d)
    return metrics.js_divergence(metrics.type_distribution(p), metrics.type_distribution(p.filter("cycle_scores.ar >= 0.5")))


@query(f"WITH w AS (SELECT {_WORDS('text')} AS w FROM documents), g AS (SELECT n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n) SELECT CAST(n AS BIGINT) AS n, round(count(DISTINCT g) / count(*), 6) AS distinct_share FROM g GROUP BY n")
def a14_distinct_n(spark, d):
    return metrics.distinct_n(table(spark, d, "documents"), "text")


@query(f"WITH g AS (SELECT unnest({_WORDS('text')}) AS g FROM documents) SELECT round(count(DISTINCT g) / count(*), 6) AS ttr FROM g")
def a15_type_token_ratio(spark, d):
    return metrics.type_token_ratio(table(spark, d, "documents"), "text")


@query()
def a17_mtld(spark, d):
    return metrics.mtld(table(spark, d, "documents"), "text")


@query()
def a18_self_bleu(spark, d):
    return metrics.self_bleu(table(spark, d, "documents"), "text", "doc_id")


@query("WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY vec_id) AS n, count(*) OVER () AS c FROM embeddings), k AS (SELECT r, CAST(('0x' || left(md5('0:i:' || r), 12)) AS BIGINT) % c AS i, CAST(('0x' || left(md5('0:j:' || r), 12)) AS BIGINT) % (c - 1) AS j, c FROM range(1000) t(r), (SELECT any_value(c) AS c FROM e)), ij AS (SELECT i + 1 AS i, (i + 1 + j) % c + 1 AS j FROM k) SELECT round(avg(1 - list_dot_product(x.v, y.v) / ((sqrt(list_dot_product(x.v, x.v)) + 1e-9) * (sqrt(list_dot_product(y.v, y.v)) + 1e-9))), 6) AS spread FROM ij JOIN e x ON ij.i = x.n JOIN e y ON ij.j = y.n")
def a19_embedding_spread(spark, d):
    return metrics.embedding_spread(table(spark, d, "embeddings"))


_STOP = ", ".join(f"'{w}'" for w in _STOP_SQL)
_SAID = P + f", n AS (SELECT DISTINCT pos, image_id, unnest(regexp_extract_all(lower(answer), '[a-z]{{4,}}')) AS noun FROM p WHERE answer <> ''), m AS (SELECT pos, noun, CASE WHEN CAST(('0x' || left(md5(image_id || noun), 1)) AS BIGINT) < 8 THEN 0 ELSE 1 END AS bad FROM n WHERE noun NOT IN ({_STOP})) "


def _presence(spark, d):
    p = pairs(spark, d).filter("answer <> ''")
    said = p.select("image_path", "image_id", F.explode(T.nouns(F.col("answer"))).alias("noun")).distinct()
    return p, said.select("image_path", "noun", (F.conv(F.left(F.md5(F.concat("image_id", "noun")), F.lit(1)), 16, 10).cast("int") < 8).alias("present"))


@query(_SAID + "SELECT round(sum(bad) / count(*), 6) AS chair_i, round(count(DISTINCT CASE WHEN bad = 1 THEN pos END) / (SELECT count(*) FROM p WHERE answer <> ''), 6) AS chair_s, (SELECT count(*) FROM p WHERE answer <> '') AS answers, count(*) AS mentions FROM m")
def a20_chair(spark, d):
    p, present = _presence(spark, d)
    return metrics.chair(p, present)[0]


@query(_SAID + "SELECT noun, count(*) AS total, CAST(sum(bad) AS BIGINT) AS hallucinated FROM m GROUP BY noun")
def a20_chair_by_noun(spark, d):
    p, present = _presence(spark, d)
    return metrics.chair(p, present)[1]


@query(P + "SELECT count(*) AS n, round(avg(clip), 6) AS mean_clip, round(avg(CASE WHEN clip < 0.2 THEN 1.0 ELSE 0.0 END), 6) AS low_rate FROM p WHERE answer <> ''")
def a21_low_alignment(spark, d):
    return metrics.low_alignment(pairs(spark, d).withColumn("clip", F.col("cycle_scores.clip")))


@query(r"WITH l AS (SELECT len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n FROM documents WHERE text IS NOT NULL) SELECT count(*) AS n, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS min, max(n) AS max FROM l")
def a22_length_stats(spark, d):
    return metrics.length_stats(table(spark, d, "documents"), "text")


@query(f"WITH w AS (SELECT {_WORDS('text')} AS w FROM documents), c AS (SELECT w[1:3] AS p, count(*) AS n FROM w WHERE len(w) >= 3 GROUP BY 1) SELECT round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS repeat_rate FROM c")
def a23_template_repeats(spark, d):
    return metrics.template_repeats(table(spark, d, "documents"), "text")


def _brief(spark, d):
    """Replies: some of them yes or no."""
    k = F.floor(F.col("pos") / 100000) % 4
    return pairs(spark, d).withColumn("prediction", F.when(k == 0, "Yes.").when(k == 1, "\n no, it isn't").when(k == 2, "Nope!").otherwise(F.col("answer"))).withColumn("gold", F.when(F.col("cycle_scores.ar") >= 0.5, "yes").otherwise("no"))


_BRIEF = P + r", b AS (SELECT *, CASE (pos // 100000) % 4 WHEN 0 THEN 'Yes.' WHEN 1 THEN E'\n no, it isn''t' WHEN 2 THEN 'Nope!' ELSE answer END AS prediction, CASE WHEN ar >= 0.5 THEN 'yes' ELSE 'no' END AS gold FROM p), y AS (SELECT *, CASE (pos // 100000) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'no' ELSE CASE WHEN lower(trim(string_split(answer, chr(10))[1])) LIKE 'yes%' THEN 'yes' WHEN lower(trim(string_split(answer, chr(10))[1])) LIKE 'no%' THEN 'no' END END AS said FROM b) "


@query(_BRIEF + "SELECT round(avg(CASE WHEN regexp_replace(lower(trim(prediction)), '[.!?]+$', '') IN ('yes', 'no') THEN 1.0 ELSE 0.0 END), 6) AS yes_no_rate FROM b WHERE trim(prediction) <> ''")
def a24_yes_no_rate(spark, d):
    return metrics.yes_no_rate(_brief(spark, d), "prediction")


@query(rf"WITH s AS (SELECT {_STRIP('text')} AS t FROM documents) SELECT round(avg(CASE WHEN regexp_matches(t, '^\p{{Lu}}') AND regexp_matches(t, '[.!?]$') THEN 1.0 ELSE 0.0 END), 6) AS shape_rate FROM s WHERE t <> ''")
def a25_sentence_shape(spark, d):
    return metrics.sentence_shape(table(spark, d, "documents"), "text")


@query(P + f"SELECT round(avg(clip), 6) AS mean_ia, round(avg(qr), 6) AS mean_iq, round(avg(CASE WHEN clip < 0.15 THEN 1.0 ELSE 0.0 END), 6) AS blind_rate, round(avg(clip) - avg({_H('other')}), 6) AS gap FROM p")
def a27_alignment(spark, d):
    return metrics.alignment(pairs(spark, d).select(F.col("cycle_scores.clip").alias("ia"), F.col("cycle_scores.qr").alias("iq"), share("other", F.col("pos")).alias("ia_shuffled")))


# benchmark scorers


@query("SELECT unnest(CASE WHEN label % 2 = 0 THEN ['all', 'even'] ELSE ['all'] END) AS category, count(*) AS n, round(avg(CASE WHEN label % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS score FROM embeddings GROUP BY 1".replace("GROUP BY 1", "GROUP BY category"))
def a28_exact_match(spark, d):
    e = table(spark, d, "embeddings").select(F.when(F.col("label") % 3 == 0, "The Cat.").otherwise("dog").alias("prediction"), F.lit("the cat").alias("gold"), F.when(F.col("label") % 2 == 0, "even").otherwise("").alias("category"))
    return benchmarks.exact_match(e)


@query("SELECT count(*) AS n, round(avg(least((1 + CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_orderkey % 3 = 0 AS INT)) / 3, 1.0)), 6) AS score FROM orders")
def a29_vqa(spark, d):
    o = table(spark, d, "orders").select(F.lit("Cat.").alias("prediction"), F.array(F.lit("cat"), F.when(F.col("o_orderkey") % 2 == 0, " CAT ").otherwise("dog"), F.when(F.col("o_orderkey") % 3 == 0, "cat!").otherwise("cow")).alias("golds"))
    return benchmarks.vqa(o)


@query("WITH c AS (SELECT unnest(['all', 'seg' || c_nationkey % 5]) AS category, c_custkey % 4 = c_nationkey % 4 AS ok FROM customer) SELECT category, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS score FROM c GROUP BY category")
def a30_multiple_choice(spark, d):
    letter = lambda c: F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col(c) % 4 + 1).cast("int"))
    c = table(spark, d, "customer").select(F.concat(F.lit("the answer is ("), F.lower(letter("c_custkey")), F.lit(")")).alias("prediction"), letter("c_nationkey").alias("gold"), F.array(*[F.lit(x) for x in "ABCD"]).alias("choices"), F.concat(F.lit("seg"), (F.col("c_nationkey") % 5).cast("string")).alias("category"))
    return benchmarks.multiple_choice(c)


@query(_BRIEF + """, z AS (SELECT count(*) AS n, count(*) FILTER (WHERE said = 'yes' AND gold = 'yes') AS tp, count(*) FILTER (WHERE said = 'yes' AND gold = 'no') AS fp, count(*) FILTER (WHERE coalesce(said, 'no') = 'no' AND gold = 'yes') AS fn, count(*) FILTER (WHERE coalesce(said, 'no') = 'no' AND gold = 'no') AS tn, count(*) FILTER (WHERE said IS NULL) AS u FROM y),
s AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS rc FROM z)
SELECT n, tp, fp, fn, tn, round((tp + tn) / greatest(n, 1), 6) AS accuracy, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / greatest(pr + rc, 1e-9), 6) AS f1, round((tp + fp) / greatest(n, 1), 6) AS yes_ratio, round(u / greatest(n, 1), 6) AS unparseable_ratio FROM s""")
def a31_yes_no(spark, d):
    return benchmarks.yes_no(_brief(spark, d))


@query("WITH s AS (SELECT 'all' AS category, list_max([1 - levenshtein(md5(CAST(c_custkey AS VARCHAR))[1:8], md5(CAST(c_nationkey AS VARCHAR))[1:8]) / 8, 1 - levenshtein(md5(CAST(c_custkey AS VARCHAR))[1:8], md5(CAST(c_custkey AS VARCHAR))[3:8]) / 8]) AS v FROM customer) SELECT category, count(*) AS n, round(avg(CASE WHEN v < 0.5 THEN 0 ELSE v END), 6) AS score FROM s GROUP BY category")
def a32_anls(spark, d):
    h = lambda c: F.left(F.md5(F.col(c).cast("string")), F.lit(8))
    rows = table(spark, d, "customer").select(h("c_custkey").alias("prediction"), F.array(h("c_nationkey"), F.substring(h("c_custkey"), 3, 6)).alias("golds"), F.lit("").alias("category"))
    return benchmarks.anls(rows)


@query("WITH r AS (SELECT l_orderkey AS s, CAST(CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS VARCHAR) AS f, l_linenumber % 7 <> 0 AND l_partkey % 11 <> 0 AS ok FROM lineitem) SELECT count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS a_acc, (SELECT round(avg(CAST(k AS INT)), 6) FROM (SELECT bool_and(ok) AS k FROM r GROUP BY s)) AS q_acc, (SELECT round(avg(CAST(k AS INT)), 6) FROM (SELECT bool_and(ok) AS k FROM r GROUP BY f)) AS f_acc FROM r")
def a33_hallusion(spark, d):
    l = table(spark, d, "lineitem")
    ok = (F.col("l_linenumber") % 7 != 0) & (F.col("l_partkey") % 11 != 0)
    rows = l.select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("question_id"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")).alias("figure_id"), F.when(ok, "Yes!").otherwise("no way").alias("prediction"), F.lit("1").alias("gold"))
    return benchmarks.hallusion(rows)


@query("SELECT count(*) AS n, round(100 * avg(CASE WHEN p_size % 4 = p_partkey % 4 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM part")
def a34_mmlu(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("Answer: "), F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("p_size") % 4 + 1).cast("int"))).alias("prediction"), (F.col("p_partkey") % 4).cast("int").alias("answer"))
    return benchmarks.mmlu(rows)


# analysis


def _results(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(F.when(F.col("c_nationkey") % 5 == 0, "full").otherwise(F.concat(F.lit("drop_"), (F.col("c_nationkey") % 5).cast("string"))).alias("method"), F.concat(F.lit("b"), F.floor(F.col("c_nationkey") / 5).cast("string")).alias("benchmark")).agg(F.round(F.avg("c_acctbal") / 10000, 2).alias("score")).filter("NOT (method = 'drop_1' AND benchmark = 'b2')")


_RES = "WITH r AS (SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'full' ELSE 'drop_' || c_nationkey % 5 END AS method, 'b' || c_nationkey // 5 AS benchmark, round(avg(c_acctbal) / 10000, 2) AS score FROM customer GROUP BY 1, 2), s AS (SELECT * FROM r WHERE NOT (method = 'drop_1' AND benchmark = 'b2')), g AS (SELECT m.method, b.benchmark, s.score FROM (SELECT DISTINCT method FROM s) m CROSS JOIN (SELECT DISTINCT benchmark FROM s) b LEFT JOIN s ON s.method = m.method AND s.benchmark = b.benchmark) "


@query(_RES + "SELECT method, benchmark, round(score, 6) AS score FROM g")
def j8_method_grid(spark, d):
    return analysis.grid(_results(spark, d))


@query(_RES + "SELECT method, " + ", ".join(f"max(CASE WHEN benchmark = 'b{k}' THEN coalesce(format('{{:.3f}}', score), '--') END) AS b{k}" for k in range(5)) + " FROM g GROUP BY method")
def a35_pivot(spark, d):
    return analysis.pivot(_results(spark, d))


@query(_RES + "SELECT g.method, g.benchmark, CASE WHEN g.score IS NULL THEN '--' WHEN g.method = 'full' OR f.score IS NULL THEN format('{:.3f}', g.score) ELSE format('{:.3f} ({:+.3f})', g.score, g.score - f.score) END AS cell FROM g LEFT JOIN (SELECT benchmark, score FROM s WHERE method = 'full') f ON g.benchmark = f.benchmark")
def a36_ablation(spark, d):
    return analysis.ablation(_results(spark, d))


@query("SELECT s_suppkey, CAST(s_suppkey % 7 + s_nationkey + CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 2.5 END AS DOUBLE) AS total_sec FROM supplier")
def a37_efficiency(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("method"), (F.col("s_suppkey") % 7).alias("prep_sec"), F.col("s_nationkey").alias("train_sec"), F.when(F.col("s_suppkey") % 3 != 0, 2.5).alias("eval_sec"))
    return analysis.efficiency(s).select("s_suppkey", "total_sec")


@query("SELECT 'b' || n_regionkey AS benchmark, string_agg(format('{:.2f}:{}', n_nationkey / 100, n_nationkey), ',' ORDER BY n_nationkey) AS series FROM nation GROUP BY n_regionkey")
def a38_sweep(spark, d):
    n = table(spark, d, "nation").select(F.format_string("x/theta_0p%02d/run.json", F.col("n_nationkey").cast("int")).alias("run"), F.concat(F.lit("b"), F.col("n_regionkey").cast("string")).alias("benchmark"), F.col("n_nationkey").alias("score"))
    return analysis.sweep(n).select("benchmark", F.array_join(F.transform("series", lambda x: F.concat(F.format_string("%.2f:", x["theta"]), x["score"].cast("string"))), ",").alias("series"))


_RATE = "CASE {c} WHEN 0 THEN ' A' WHEN 1 THEN 'b' ELSE 'tie' END"
_RAT = "WITH r AS (SELECT CASE (quality + doc_id) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'tie' END AS x, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CASE (toxic + doc_id) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'tie' END END AS y FROM labels) "


def _ratings(spark, d):
    lab = lambda c: F.element_at(F.array(F.lit(" A"), F.lit("b"), F.lit("Tie")), ((F.col(c) + F.col("doc_id")) % 3 + 1).cast("int"))
    return table(spark, d, "labels").select(lab("quality").alias("rater_1"), F.when(F.col("doc_id") % 10 == 0, "?").otherwise(lab("toxic")).alias("rater_2"))


@query(_RAT + "SELECT label, count(*) AS n, round(count(*) / (SELECT count(x) + count(y) FROM r), 6) AS rate FROM (SELECT x AS label FROM r UNION ALL SELECT y FROM r) WHERE label IS NOT NULL GROUP BY label")
def a39_win_rates(spark, d):
    return analysis.win_rates(_ratings(spark, d), ["rater_1", "rater_2"])


@query(_RAT + ", v AS (SELECT * FROM r WHERE y IS NOT NULL), s AS (SELECT count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS po, " + " + ".join(f"avg(CASE WHEN x = '{t}' THEN 1.0 ELSE 0.0 END) * avg(CASE WHEN y = '{t}' THEN 1.0 ELSE 0.0 END)" for t in ("a", "b", "tie")) + " AS pe FROM v) SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM s")
def a40_kappa(spark, d):
    return analysis.kappa(_ratings(spark, d), "rater_1", "rater_2")


@query("SELECT event_id, round(1 / (1 + exp((value - (SELECT avg(value) FROM events)) / 5)), 6) AS ppl_score FROM events")
def a41_perplexity_scores(spark, d):
    return metrics.perplexity_scores(table(spark, d, "events").select("event_id", F.col("value").alias("ppl"))).select("event_id", "ppl_score")


# mixing


def _pools(spark, d):
    p = pairs(spark, d).select("key", "pos")
    k = F.floor(F.col("pos") / 100000) % 3
    dup = p.filter(F.floor(F.col("pos") / 100000) % 12 == 0)
    return p.filter(k == 0), p.filter(k == 1).union(dup), p.filter(k == 2)


@query(P + """, a AS (SELECT key, pos FROM p WHERE (pos // 100000) % 3 = 0 ORDER BY md5('4:' || key), key LIMIT 60),
b AS (SELECT key, pos FROM (SELECT key, pos FROM p WHERE (pos // 100000) % 3 = 1 UNION ALL SELECT key, pos FROM p WHERE (pos // 100000) % 12 = 0) ORDER BY md5('4:' || key), key LIMIT 30),
c AS (SELECT key, pos FROM p WHERE (pos // 100000) % 3 = 2 ORDER BY md5('5:' || key), key LIMIT 10),
u AS (SELECT key, 0 AS o FROM a UNION ALL SELECT key, 1 FROM b UNION ALL SELECT key, 2 FROM c)
SELECT key, ['new', 'original', 'historical'][min(o) + 1] AS pool, md5('4:' || key) AS place FROM u GROUP BY key""")
def c1_mix_pools(spark, d):
    return mixing.mix_pools(*_pools(spark, d), 100, (0.6, 0.3, 0.1), 4).select("key", "pool", "place")


@query(P + "SELECT key FROM p ORDER BY md5('7:' || key), key LIMIT 40")
def c2_exact_sample(spark, d):
    return mixing.sample_exact(pairs(spark, d), 40, 7).select("key")


@query(P + ", q AS (SELECT *, CASE WHEN (pos // 100000) % 3 = 0 THEN 'counting' ELSE qa_type END AS t2 FROM p), n AS (SELECT count(*) FILTER (WHERE t2 = 'counting') AS c, count(*) FILTER (WHERE t2 <> 'counting') AS o FROM q), r AS (SELECT pos, t2, row_number() OVER (PARTITION BY t2 ORDER BY md5('0:' || pos), pos) AS i FROM q) SELECT pos FROM r, n WHERE t2 <> 'counting' OR i <= CASE WHEN c > floor(0.4 * o / 0.6 + 1e-9) THEN greatest(1, floor(0.4 * o / 0.6 + 1e-9)) ELSE c END")
def c3_rebalance(spark, d):
    p = pairs(spark, d)
    skewed = p.withColumn("question", F.when(F.floor(F.col("pos") / 100000) % 3 == 0, F.lit("How many are there?")).otherwise(F.col("question")))
    return mixing.rebalance(skewed, 0.40, 0, "pos").select("pos")


# text functions


@query(P + f"SELECT pos, {_NORM('question')} AS q FROM p")
def t1_normalise_question(spark, d):
    return pairs(spark, d).select("pos", T.normalise_question(F.col("question")).alias("q"))


@query(f"SELECT doc_id, {_STRIP(f'''regexp_replace(regexp_replace(lower({_STRIP('text')}), '[.,!?\"' || chr(39) || ']', ' ', 'g'), '{_SP}', ' ', 'g')''')} AS a FROM documents")
def t2_normalise_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise_answer(F.col("text")).alias("a"))


@query(f"SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '')[1], '') AS line FROM documents")
def t3_first_line(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_line(F.col("text")).alias("line"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' END AS letter FROM supplier")
def t4_choice_letter(spark, d):
    k = F.col("s_suppkey") % 3
    return table(spark, d, "supplier").select("s_suppkey", T.choice_letter(F.when(k == 0, "it is b, e or f").when(k == 1, "a cat").otherwise("Fish")).alias("letter"))


@query(_BRIEF + "SELECT pos, said FROM y")
def t6_yes_no(spark, d):
    return _brief(spark, d).select("pos", T.pope_yes_no(F.col("prediction")).alias("said"))


@query("SELECT c_custkey, round(1 - levenshtein(md5(CAST(c_custkey AS VARCHAR)), md5(CAST(c_nationkey AS VARCHAR))) / 32, 6) AS nls FROM customer")
def t9_nls(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.nls(F.md5(F.col("c_custkey").cast("string")), F.md5(F.col("c_nationkey").cast("string"))).alias("nls"))


@query(P + "SELECT pos, qa_type FROM p")
def t10_qa_type(spark, d):
    return pairs(spark, d).select("pos", T.qa_type(F.col("question")).alias("qa_type"))


@query(f"SELECT doc_id, len({_WORDS('text')}) AS n_words, md5(array_to_string({_WORDS('text')}, ' ')) AS digest FROM documents")
def t13_words(spark, d):
    w = T.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).alias("n_words"), F.md5(F.array_join(w, " ")).alias("digest"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda x: x NOT IN ({_STOP})))), ' ') AS nouns FROM documents")
def t14_nouns(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.nouns(F.col("text")), " ").alias("nouns"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\b\d+/\d+\b|\d+(?:\.\d+)?%?'))), ' ') AS numbers FROM documents")
def t20_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), " ").alias("numbers"))


@query(P + "SELECT pos, concat_ws(' ', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(question || chr(10) || answer), '{w}')" for w in words) + f" THEN '{name}' END" for name, words in _RISKS_SQL.items()) + ") AS risks FROM p")
def t21_risk_types(spark, d):
    return pairs(spark, d).select("pos", F.array_join(T.risk_types(F.col("question"), F.col("answer")), " ").alias("risks"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(contradicts?|differs|different|in(consistent|correct)|instead of|not (correct|supported)|rather than|should be|wrong)\b') AS hit FROM documents")
def t23_contradiction(spark, d):
    return table(spark, d, "documents").select("doc_id", T.contradicts(F.col("text")).alias("hit"))


@query(P + "SELECT pos, round(ar, 6) AS ar, round(clip, 6) AS clip, round(qr, 6) AS qr, round(ppl, 6) AS ppl, round(composite, 6) AS composite FROM p")
def t25_composite(spark, d):
    return pairs(spark, d).select("pos", "cycle_scores.*")


@query("SELECT page_id, left(md5(url), 12) AS image_id, left(md5(encode(html)[1:4096]), 10) AS page_hash FROM pages")
def t26_hashes(spark, d):
    return table(spark, d, "pages").select("page_id", T.short_hash(F.col("url")).alias("image_id"), T.short_hash(F.col("html"), 10, 4096).alias("page_hash"))


# extraction


@query("SELECT page_id, CAST(k AS BIGINT) AS n, CASE k WHEN 0 THEN 'http://h/a/' || page_id || '.png' WHEN 1 THEN 'http://h/b.png' ELSE 'http://h/a/c.png' END AS src, CASE k WHEN 0 THEN 'Figure ' || page_id WHEN 1 THEN 'alt text' ELSE 'after' END AS text FROM pages, generate_series(0, 2) g(k)")
def x1_html_images(spark, d):
    extra = F.concat(F.lit("<figure><img src='"), F.col("page_id").cast("string"), F.lit(".png' alt='no'><figcaption>Figure "), F.col("page_id").cast("string"), F.lit("</figcaption></figure><img src='/b.png' alt='alt text'><div><img src='c.png'><p>after</p></div><img src='' alt='x'>"))
    pages = table(spark, d, "pages").select("page_id", F.lit("http://h/a/").alias("url"), F.concat(extra, "html").alias("html"))
    return extract.html_images(pages)


@query(f"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: {_STRIP('x')}), lambda x: len(x) >= 10) AS a FROM documents) SELECT doc_id, CASE WHEN contains(para, '?') THEN 'question' ELSE 'answer' END AS kind, count(*) AS n FROM (SELECT doc_id, unnest(a) AS para FROM s) GROUP BY ALL")
def x4_routed_paragraphs(spark, d):
    return extract.routed(table(spark, d, "documents")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([。！？；?!])\s*', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, E' \t\r\n') <> '')) AS n_sentences FROM documents")
def x5_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query()
def x6_chunks(spark, d):
    return extract.chunks(table(spark, d, "documents")).select("doc_id", "n", F.length("chunk").alias("n_chars"))


# sources and sinks: what is written is read again


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


_CHAT = P + "SELECT pos, image_id, question, answer, round(composite, 6) AS composite FROM p"


def _chat(spark, d):
    return filters.to_chat(pairs(spark, d))


def _read_back(df):
    """pos travels in image_id, which the schema of pools knows."""
    at = F.split("image_id", "#")
    return df.select(at[0].cast("bigint").alias("pos"), at[1].alias("image_id"), "question", "answer", "cycle_scores.composite")


def _with_pos(df):
    return df.withColumn("image_id", F.concat_ws("#", "pos", "image_id"))


@query(_CHAT)
def k1_json_array(spark, d):
    at = _fresh(spark, "k1") + ".json"
    writers.write_json_array(_with_pos(_chat(spark, d)), at)
    return _read_back(readers.json_pool(spark, at))


@query(_CHAT)
def k2_json_lines(spark, d):
    at = _fresh(spark, "k2")
    writers.write_json_lines(_with_pos(_chat(spark, d)), at)
    return _read_back(readers.json_pool(spark, at))


@query(_CHAT)
def s2_strict_json_lines(spark, d):
    at = _fresh(spark, "s2")
    writers.write_json_lines(_with_pos(_chat(spark, d)), at)
    return _read_back(readers.json_lines(spark, at, readers.VQA_SCHEMA))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation")
def s4_json_data(spark, d):
    at = _fresh(spark, "s4")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x)  # 25 rows
    table(spark, d, "nation").agg(F.to_json(F.struct(rows.alias("data")))).write.text(at)
    return readers.json_data(spark, at, "struct<n_nationkey bigint, n_name string>")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS question_id, n_name AS question FROM nation")
def s5_json_by_key(spark, d):
    at = _fresh(spark, "s5")
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("question")))))  # 25 rows
    table(spark, d, "nation").agg(F.to_json(entries)).write.text(at)
    return readers.json_by_key(spark, at, "struct<question string>")


#: Spark's CSV writer strips white space at the ends of texts unless told not to.
_EXACT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text <> ''")
def s6_csv_texts(spark, d):
    at = _fresh(spark, "s6")
    table(spark, d, "documents").select("doc_id", "text").filter("text <> ''").write.csv(at, header=True, quoteAll=True, escape='"', lineSep="\n", **_EXACT)
    return readers.csv_texts(spark, at, "doc_id bigint, text string").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS \"index\", p_name AS question, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 3 END AS n_choices, p_brand AS a FROM part")
def s7_choices_tsv(spark, d):
    at = _fresh(spark, "s7")
    p = table(spark, d, "part")
    p.select(F.col("p_partkey").cast("string").alias("index"), F.col("p_name").alias("question"), F.lit(None).cast("string").alias("hint"), F.col("p_brand").alias("A"), F.lit("b").alias("B"), F.lit('say "c"').alias("C"), F.when(F.col("p_partkey") % 2 == 0, "d").alias("D"), F.lit("A").alias("answer"), F.lit("x").alias("category"), F.lit("y").alias("l2-category")).write.csv(at, sep="\t", header=True, quote='"', escape='"', **_EXACT)
    return readers.choices_tsv(spark, at).select("index", "question", F.size("choices").alias("n_choices"), F.col("choices")["A"].alias("a"))


@query("SELECT page_id, md5(html) AS digest FROM pages")
def s10_pages(spark, d):
    at = _fresh(spark, "s10") + ".jsonl"
    writers.write_json_lines(table(spark, d, "pages").select(F.concat_ws("#", "page_id", "url").alias("url"), "html"), at)
    return readers.pages(spark, at).select(F.split("url", "#")[0].cast("bigint").alias("page_id"), F.md5("html").alias("digest"))


# more text functions


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN source = '' THEN trim(lang) ELSE trim(source) END AS first, CASE WHEN source LIKE '/%' THEN source ELSE '/data/' || source END AS path FROM documents")
def f15_f17_fields(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_field(F.col("source"), F.col("lang")).alias("first"), filters.resolve_path(F.col("source"), "/data/").alias("path"))


@query(P + "SELECT pos, question AS q_own, answer AS a_own, image_path AS i_own, regexp_replace(question, '<image>', '') AS q_turn, answer AS a_turn FROM p")
def t11_t12_sample_fields(spark, d):
    c = _chat(spark, d)
    no = F.lit(None).cast("string")
    return c.select("pos", T.sample_question(F.col("question"), F.col("messages")).alias("q_own"), T.sample_answer(F.lit(""), F.col("messages")).alias("a_own"), T.sample_image(no, F.col("images")).alias("i_own"), T.sample_question(no, F.col("messages")).alias("q_turn"), T.sample_answer(F.col("answer"), F.col("messages")).alias("a_turn")).select("pos", "q_own", "a_own", "i_own", "q_turn", "a_turn")


@query(P + f"SELECT pos, {_STRIP('question')} AS question, {_STRIP('answer')} AS answer FROM p")
def t16_qa_output(spark, d):
    x = T.qa_pair(F.concat(F.lit("noise\nQ: "), "question", F.lit(" \nA: "), "answer"))
    return pairs(spark, d).filter("answer <> ''").select("pos", x["question"].alias("question"), x["answer"].alias("answer"))


@query(f"SELECT doc_id, {_STRIP('text')} AS t FROM documents")
def t17_after_think(spark, d):
    k = F.col("doc_id") % 2 == 0
    return table(spark, d, "documents").select("doc_id", T.after_think(F.when(k, F.concat(F.lit("<think> a </think>\n"), "text")).otherwise(F.col("text"))).alias("t"))


@query(f"SELECT doc_id, coalesce(list_filter(list_transform(string_split(t, chr(10)), lambda x: {_STRIP('x')}), lambda x: regexp_matches(x, '^(?i)(fig\\.?|figure|table)\\s*[0-9]'))[1], CASE WHEN t <> '' THEN left(t, 200) END) AS caption FROM (SELECT doc_id, {_STRIP('u')} AS t FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || ' Table 7: what is left ' ELSE text END AS u FROM documents))")
def t24_caption(spark, d):
    u = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n Table 7: what is left "))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.caption(u).alias("caption"))


@query(P + "SELECT pos, 2 AS n_parts, image_path AS image, question AS text FROM p")
def t32_image_message(spark, d):
    c = _chat(spark, d)
    parts = generation.image_message(F.col("messages")[0]["content"], F.col("images"))
    return c.select("pos", F.size(parts).alias("n_parts"), parts[0]["value"].alias("image"), parts[1]["value"].alias("text"))


@query("SELECT o_orderkey, printf('COCO_val2014_%012d.jpg', o_orderkey) AS name FROM orders")
def t33_coco_name(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.coco_name("val2014", F.col("o_orderkey")).alias("name"))


@query("SELECT p_partkey, p_name || E'\\nSay yes or no.' AS pope, p_type || chr(10) || p_name || E'\\nA. x\\nB. ' || p_brand || E'\\nGive the letter of the right option only.' AS mmbench, p_name || E'\\nA. x\\nB. ' || p_brand || E'\\nC. y\\nD. z\\nAnswer:' AS mmlu FROM part")
def t34_g11_prompts(spark, d):
    q, two = F.col("p_name"), F.create_map(F.lit("B"), F.col("p_brand"), F.lit("A"), F.lit("x"))
    return table(spark, d, "part").select("p_partkey", benchmarks.prompt("pope", q).alias("pope"), benchmarks.prompt("mmbench", q, F.col("p_type"), two).alias("mmbench"), benchmarks.prompt("mmlu", q, choices=F.array(F.lit("x"), F.col("p_brand"), F.lit("y"), F.lit("z"))).alias("mmlu"))


# stages around a model: here one that answers with the md5 of what it is asked


def _model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(lambda x: "<think>so</think> Q: " + md5(x.encode()).hexdigest() + "\nA: yes")


_ASKED = lambda prompt: "'Q: ' || md5(" + prompt + ") || E'\\nA: yes'"


@query(P + f"SELECT {_ASKED(chr(39) + 'Ask a question to which this is the answer:' + chr(39) + ' || chr(10) || ' + _STRIP('answer'))} AS instruction, '' AS input, {_STRIP('answer')} AS output FROM p WHERE answer <> ''")
def g3_question_records(spark, d):
    return generation.question_records(pairs(spark, d).select(F.col("answer").alias("output"), F.lit(None).cast("string").alias("text")), _model)


@query(P + f"SELECT 'Write a question that the text below answers.' AS instruction, {_ASKED(chr(39) + 'Answer the question:' + chr(39) + ' || chr(10) || ' + _STRIP('question'))} AS input, {_STRIP('question')} AS output FROM p")
def g4_answer_records(spark, d):
    return generation.answer_records(pairs(spark, d).select(F.col("question").alias("instruction"), F.lit(None).cast("string").alias("text")), _model)


@query(P + "SELECT image_path, left(md5(image_path), 12) AS image_id, md5('Ask and answer one question about the image. Context: ' || answer) AS question, 'yes' AS answer, 'md5' AS generation_model FROM p, range(2)")
def g5_visual_pairs(spark, d):
    return generation.visual_pairs(pairs(spark, d).select("image_path", F.col("answer").alias("source_text")), _model, 2, "md5")


@query(P + "SELECT pos, md5('Answer: ' || question) AS again, CASE WHEN left(md5('Answer: ' || question), 1) < '8' THEN 1.0 ELSE 0.0 END AS ar, 1.0 AS qr FROM p")
def g6_verify_cycle(spark, d):
    low = lambda own, again: F.when(F.length(again) > 40, F.when(F.regexp_extract(again, "Q: (.)", 1) < "8", 1.0).otherwise(0.0)).otherwise(1.0)
    short = lambda batches: (b.map(lambda x: "") for b in batches)
    short.__annotations__ = _model.__annotations__
    got = generation.verify_cycle(pairs(spark, d).drop("cycle_scores"), _model, short, low, F.lit(0.5))
    return got.select("pos", F.regexp_extract("answer_again", "Q: (.{32})", 1).alias("again"), "cycle_scores.ar", "cycle_scores.qr")


@query(P + "SELECT pos, false AS supported, 'other' AS error_type, false AS keep_final FROM p")
def g7_verify_grounded(spark, d):
    return generation.verify_grounded(pairs(spark, d), _model).select("pos", "supported", "error_type", "keep_final")


@query(P + "SELECT pos, CASE qa_type WHEN 'counting' THEN 'Ask one question whose answer is a number of things in the picture.' WHEN 'objects' THEN 'Ask for one or more things that are in the picture; yes or no must not answer it.' WHEN 'spatial' THEN 'Ask one question about where something is, seen from something else.' WHEN 'actions' THEN 'Ask one question about what a person or an animal is doing.' WHEN 'text_ocr' THEN 'Ask one question about words that can be read in the picture.' ELSE 'Ask one question whose answer has to be concluded from what can be seen.' END AS task FROM p")
def c4_typed_task(spark, d):
    return pairs(spark, d).select("pos", generation.typed_task(T.qa_type(F.col("question"))).alias("task"))


@query("SELECT left(md5(src), 12) || '.png' AS image_path, text AS source_text, 'web_image' AS source_type, src AS url FROM (SELECT page_id, 'http://h/a/' || page_id || '.png' AS src, 'Figure ' || page_id AS text FROM pages) WHERE page_id % 2 = 0")
def x2_web_samples(spark, d):
    """Pages with one figure each; the images of even pages come back, 300 pixels square."""
    own = F.concat(F.lit("<figure><img src='"), F.col("page_id").cast("string"), F.lit(".png'><figcaption>Figure "), F.col("page_id").cast("string"), F.lit("</figcaption></figure>"))
    pages = table(spark, d, "pages").select("page_id", F.lit("http://h/a/").alias("url"), own.alias("html"))
    even = lambda address: b"x" if int(address.split("/")[-1][:-4]) % 2 == 0 else None
    return extract.web_samples(pages, even, lambda data: (300, 300)).drop("content")


@query("SELECT 'p' || page_id AS path, n AS page, printf('page_%04d_%s.png', n, left(md5('page' || n), 10)) AS image_path, CASE n WHEN 0 THEN 'Figure 1 of ' || page_id ELSE 'plain text' END AS source_text FROM pages, (SELECT unnest([0, 1]) AS n)")
def x3_pdf_samples(spark, d):
    """Files of two pages each: the bytes of a page's picture are its text."""
    files = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.encode(F.concat(F.lit("intro\nFigure 1 of "), F.col("page_id").cast("string")), "utf-8").alias("content"))
    render = lambda data: [(data, b"page0"), (b"plain text", b"page1")]
    return extract.pdf_samples(files, render, lambda picture: picture.decode()).select("path", F.col("page").cast("bigint").alias("page"), "image_path", "source_text")


@query(P + """SELECT pos, md5('[{"type":"image","value":"' || image_path || '"}]') AS said FROM p""")
def g2_generate_with_images(spark, d):
    got = generation.generate_with_images(pairs(spark, d), _model, F.lit("<image>"), F.array("image_path"))
    return got.select("pos", F.regexp_extract("output", "Q: (.{32})", 1).alias("said"))


def _close(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield (a.str.len() < b.str.len()).astype(float)


@query(P + "SELECT pos, CASE WHEN len(question) < len(answer) THEN 1.0 ELSE 0.0 END AS score FROM p")
def g8_paired_scorer(spark, d):
    return pairs(spark, d).select("pos", generation.paired(_close)(F.col("question"), F.col("answer")).alias("score"))


# the rest


@query("SELECT o_orderkey, round((CAST(o_orderkey % 2 = o_custkey % 2 AS INT) + CAST(o_orderkey % 3 = o_custkey % 3 AS INT) + CAST(o_orderkey % 5 = o_custkey % 5 AS INT)) / 3, 6) AS agreement FROM orders")
def d5_agreement(spark, d):
    of = lambda c: F.array(*[F.col(c) % k for k in (2, 3, 5)])
    return table(spark, d, "orders").select("o_orderkey", dedup.agreement(of("o_orderkey"), of("o_custkey")).alias("agreement"))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4_semi_anti(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    good, known = labels.filter("quality = 1").select("doc_id"), labels.select("doc_id")
    inside = docs.join(known, "doc_id", "left_semi")
    parts = inside.join(good, "doc_id", "left_semi").withColumn("good", F.lit(True)), inside.join(good, "doc_id", "left_anti").withColumn("good", F.lit(False))
    return parts[0].union(parts[1]).union(docs.join(known, "doc_id", "left_anti").withColumn("good", F.lit(None).cast("boolean")))


@query("SELECT * FROM (VALUES (0, 0.6, 0.1, 8, 0.0002), (1, 0.6, 0.2, 8, 0.0001), (2, 0.5, 0.3, 16, 0.0001), (3, 0.5, 0.3, 16, 0.00005), (4, 0.5, 0.3, 32, 0.00005), (9, 0.5, 0.3, 32, 0.00005)) t(round_id, new_share, old_share, rank, rate)".replace("SELECT *", "SELECT CAST(round_id AS BIGINT) AS round_id, CAST(new_share AS DOUBLE) AS new_share, CAST(old_share AS DOUBLE) AS old_share, CAST(rank AS BIGINT) AS rank, CAST(rate AS DOUBLE) AS rate"))
def t27_t28_schedules(spark, d):
    rows = [(r, mixing.scheduled((0.6, 0.6, 0.5), r), mixing.scheduled((0.1, 0.2, 0.3), r), mixing.lora_settings(r)[0], mixing.lora_settings(r)[2]) for r in (0, 1, 2, 3, 4, 9)]
    return spark.createDataFrame(rows, "round_id bigint, new_share double, old_share double, rank bigint, rate double")


@query(_LONG + ", s AS (SELECT component, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM l GROUP BY component) SELECT component, n AS count, round(mean, 6) AS mean, round(std, 6) AS std, round(v[1], 6) AS min, round(v[n], 6) AS max, " + ", ".join(f"round(v[CAST(round_even({p} / 100 * (n - 1), 0) AS BIGINT) + 1], 6) AS p{p}" for p in (25, 50, 75, 90, 95, 99)) + ", n AS in_bins FROM s")
def a6_component_stats(spark, d):
    got = metrics.component_stats(pairs(spark, d))
    total = F.aggregate(F.map_values("histogram"), F.lit(0).cast("bigint"), lambda t, x: t + x)
    return got.withColumn("in_bins", total).drop("histogram")
