"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of documents; the last returns the
encoded documents. A stage judges its own input only: written as Parquet and read again, its result is the next one's docs.
Nulls, empty texts, ties, repeated rows and empty tables have the results that the operators' modules define.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from winnow.llm import bpe, line_dedup, mixing, quality, simhash
from winnow.llm.common import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stood earlier in the corpus go, and documents of which none is left."""
    return line_dedup.drop_repeated_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights under the token budget."""
    return mixing.mixed_documents(docs, mixing.WEIGHTS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the decoder's confirmation that they give the text back."""
    return bpe.encode(docs)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("SimHash near-dedup", near_stage), ("source mixing", mixing_stage), ("BPE encoding", encoding_stage)]

#: SQL can express neither the classifier nor the fingerprints; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
    return docs
