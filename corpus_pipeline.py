"""A training corpus from documents: toxicity, quality rules, near duplicates, long repeats, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept.  Between stages the documents are written as Parquet to the
shared folder and read again, which cuts the lineage.  All but the last stage
return the columns of documents; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paragram.llm import debruijn, ngram_join, packing, rules, storage, toxicity
from paragram.llm.queries import END_ID, documents, labels, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees don't call toxic."""
    return toxicity.accepted(docs, toxicity.train(docs, labels(spark, sf_dir)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy of the rule ledger keeps."""
    return rules.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.representatives(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of long repeated spans."""
    return debruijn.cleaned(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), END_ID, 4096)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_spans", repeats_stage),
    ("packing", packing_stage),
]

#: Trees, MinHash and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
