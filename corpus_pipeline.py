"""A training corpus from raw documents: five stages, each one of the operators of the llm subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orogen.llm import decontamination, packing, paragraphs, quality, simhash
from orogen.llm.base import crc32_of_id, delete, read, shared_folder, temporary
from orogen.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts have the score of an empty text."""
    model = quality.learned(docs, read(spark, sf_dir, "labels"), crc32_of_id() % 5 != 0)
    return quality.accepted(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id, null ids last.

    All texts without words are one group. Of rows with one doc_id (or none) and one text one stays.
    """
    return simhash.one_of_each(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay in the first document that has them. Rows with a null text or doc_id stay as they are."""
    return paragraphs.without_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a test item go, each row judged by its text alone; null texts stay."""
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. A null text is an empty document; rows that repeat an id are documents of their own."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("substring dedup", passage_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot fit the classifier; tests/llm/test_pipeline.py holds each stage and run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, [f"{folder}/{k - 1}"])
    return docs
