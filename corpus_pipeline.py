"""A corpus pipeline: five stages over ``documents``, each working on all that the one before kept.

In every stage a row is a document, whatever its id: null and repeated ids lose nothing. Extra columns pass through the
first four stages, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, langid, mixing, neardup, quality
from tidemark.plans.lineage import new_table_path
from tidemark.plans.rows import packed, unpacked


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null and empty texts are scored like any other, rows that repeat each."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null texts and those without a letter go, rows that repeat stay or go together."""
    return langid.keep_identified(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of 5 words, similarity of 0.8 or more.

    Documents go by ``row_key``, not by their id: null and repeated ids are documents of their own. Rows that are equal
    in all columns are one. Null and empty texts are near nothing and stay, one for each different row.
    """
    rows = packed(docs)
    kept = neardup.near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("row").getField("text").alias("text")), shingle=5, percent=80).where("kept")
    return unpacked(rows.join(kept.select(F.col("doc_id").alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"]), docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; texts without a word never come, null is a source of its own."""
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded documents, a row for each; null texts have no tokens."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", dedup_stage),
    ("mixing sources to target weights", mix_stage),
    ("byte-level BPE encoding and decoding", encode_stage),
]

#: The stages train models and follow links; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_table_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
