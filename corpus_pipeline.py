"""From ``documents`` to packed sequences: toxicity, near duplicates, passages, packing.

Each stage is one of the numbered operators with its production parameters.  All
but the last return the columns they got; each one's rows are written as Parquet
to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import chaining, jaccard, packing, toxicity
from quire.llm._common import table, written
from quire.llm.fragments import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from ``labels``, does not predict as toxic."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return jaccard.first_documents(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in a document of smaller id."""
    return chaining.remove_passages(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its offset there."""
    return packing.pack(docs, tokenizer_path(packing.VOCABULARY))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("substring_dedup", cut_passages),
    ("packing", pack_sequences),
]

#: The stages are beyond SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
