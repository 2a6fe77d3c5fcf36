"""The queries of this subpackage, over the whole of their tables with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from winnow.llm import bpe, itq, licenses, line_dedup, media, mixing, pii, quality, simhash
from winnow.llm.common import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.classes(table(spark, sf_dir, "embeddings"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.WEIGHTS)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds media; the picture of every vector of embeddings stands in for a media column."""
    return media.classes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", media.drawer())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.keep_bitmaps(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_pii_spans": op2_pii_spans,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_source_mixing": op4_source_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_media_copies": op7_media_copies,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_bpe_round_trip": op10_bpe_round_trip,
}

SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE c AS (SELECT embedding, min(vec_id) AS class_id FROM embeddings WHERE vec_id IS NOT NULL GROUP BY embedding),
p AS (
  SELECT a.class_id AS a, b.class_id AS b FROM c a JOIN c b ON a.class_id <> b.class_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95),
g(id, seen) AS (SELECT class_id, class_id FROM c UNION SELECT p.b, g.seen FROM g JOIN p ON g.id = p.a),
m AS (SELECT id, min(seen) AS group_id FROM g GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, c.class_id, coalesce(n.n, 0) AS n_links, m.group_id
FROM embeddings e JOIN c ON e.embedding = c.embedding JOIN m ON m.id = c.class_id LEFT JOIN n ON n.a = c.class_id
WHERE e.vec_id IS NOT NULL""",
    "op4_source_mixing": """
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS tokens, md5('42:' || doc_id) AS key
  FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, source, tokens, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS DOUBLE)
  / CASE source WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 1.5 WHEN 'src4' THEN 0.5 WHEN 'src6' THEN 3.0 ELSE 1.0 END AS finish FROM t),
r AS (SELECT *, sum(tokens) OVER (ORDER BY finish, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS run, sum(tokens) OVER () AS total FROM f)
SELECT doc_id, source, tokens, finish FROM r WHERE run <= floor(0.5 * total)""",
    "op8_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents WHERE doc_id IS NOT NULL)),
k AS (
  SELECT doc_id, pos, regexp_full_match(line, '[\\t\\v\\f\\r ]*') OR row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 AS keep FROM l),
c AS (SELECT *, CASE WHEN keep = lag(keep, 1, true) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS turn FROM k),
g AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
n AS (SELECT doc_id, run, count(*) AS n, count(*) FILTER (WHERE keep) AS kept FROM g GROUP BY doc_id, run)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(kept) AS BIGINT) AS n_kept,
  CASE WHEN min(run) = 1 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS keep_runs
FROM n GROUP BY doc_id""",
}
