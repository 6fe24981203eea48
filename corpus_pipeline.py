"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

quality_rules drops rejected documents and lines above their limit; near_dedup keeps one
document of each group; substring_dedup cuts passages that an earlier document has;
source_mix brings sources to their target weights, as one row for each document with the
words that the mix takes; bpe encodes what is left. Where a text changes, n_chars follows. Null texts fail the first
stage's rules; null ids and sources, ties, repeated rows and further columns go through as
the operators' docstrings say; an empty table gives empty stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.llm import bpe, mixing, near_dedup, quality_rules, substring_dedup
from driftmap.llm.tables import shared_folder


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and aren't depleted, without lines above their host's limit."""
    return _counted(quality_rules.clean_documents(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each component of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that a document of a smaller doc_id has; texts of which nothing is left go."""
    return _counted(substring_dedup.dedup_texts(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document of which the mix takes words, with those words."""
    return _counted(mixing.mixed_documents(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of each document of the mix."""
    return bpe.encode_checked(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("source_mix", mix_stage),
    ("bpe", bpe_stage),
]

#: The mix's permutations and BPE can't be written in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
