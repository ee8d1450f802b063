"""Documents to packed training sequences, stage by stage.

Each stage takes what the one before it kept.  All but the last return the
columns of documents, whatever their names, in their order.

A missing or empty text has no words, so the quality rules reject it; a very long one goes through whole.  Of repeated rows one
stays.  An empty table has no rows after any stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from repometrics.llm import ngram_join, packing, quality, substring_dedup
from repometrics.llm.queries import vocabulary_path
from repometrics.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return ngram_join.keep_one(docs, size=5, threshold=0.8)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that a document with a smaller id has are removed; every document stays."""
    return substring_dedup.clean(docs, size=13)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their places in sequences."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_removal),
    ("best-fit packing", best_fit_packing),
]

#: The stages use classes of near copies and the tokenizers library, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{k}-{uuid.uuid4().hex}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
