"""A corpus pipeline: quality, exact and near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and all but the last return the
columns of ``documents``.  In every stage a null text is empty, a null id is a document below all others, and an empty table stays
empty; other columns pass as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kindred.llm.common import shared_table
from kindred.llm.decontaminate import drop_contaminated
from kindred.llm.exact_dedup import drop_exact_copies
from kindred.llm.ngram_join import drop_near_copies
from kindred.llm.packing import pack
from kindred.llm.quality import keep_quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more, each row by its own text; without labels all score 0.5 and stay."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of rows that repeat it, one."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the document with the smallest id.

    Rows that repeat an id with several texts are one document, whose groups are joined."""
    return drop_near_copies(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window of ten words, each row by its own text; an empty benchmark drops nothing."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens; every row is a document of its own, an empty text its end alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier and the tokenizer are beyond SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
