"""Queries of this subpackage, op1 to op10, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; in fewer files than the session has cores they are dealt to all cores, as one file may be one task."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs._jdf.inputFiles()) < cores else docs


def op1_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paragram.llm import sstable, storage

    folder = storage.scratch(spark, "sstable")
    shards = sstable.write_shards(documents(spark, sf_dir), folder, tokenizer_path("byte_bpe_50k.json"), END_ID)
    return sstable.read_shards(spark, folder, shards)


def op2_weighted_sampling_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paragram.llm import weighted_sampling

    return weighted_sampling.edited_fingerprints(documents(spark, sf_dir))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paragram.llm import packing

    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), END_ID, 4096)


def op4_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paragram.llm import suffix_matching

    return suffix_matching.digest(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_debruijn_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paragram.llm import debruijn

    return debruijn.deduplicated(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paragram.llm import ranking

    table = ranking.featured(documents(spark, sf_dir))
    return ranking.ranked(table, ranking.learn(table, labels(spark, sf_dir)))


def op10_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paragram.llm import toxicity

    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, labels(spark, sf_dir)))


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paragram.llm import prefix_counts

    return prefix_counts.prefix_counts(prefix_counts.stored_tables(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model")), 4096)


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paragram.llm import rules

    return rules.judged(rules.ledger(documents(spark, sf_dir))).select(*rules.DIGEST)


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every rule of the standard policy: how many documents fail it, and fail it alone, from the ledger's bits."""
    from paragram.llm import rules

    return rules.ablation(rules.ledger(documents(spark, sf_dir)), rules.STANDARD).withColumn("bit", F.col("bit").cast("long"))


def op9_minhash_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paragram.llm import ngram_join

    return ngram_join.joined(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sstable_tokens": op1_sstable_tokens,
    "op2_weighted_sampling_fingerprints": op2_weighted_sampling_fingerprints,
    "op3_sum_of_squares_packing": op3_sum_of_squares_packing,
    "op4_suffix_array_pieces": op4_suffix_array_pieces,
    "op5_debruijn_substring_dedup": op5_debruijn_substring_dedup,
    "op6_bradley_terry_quality": op6_bradley_terry_quality,
    "op7_prefix_token_counts": op7_prefix_token_counts,
    "op8_rule_ledger": op8_rule_ledger,
    "rule_ablation": rule_ablation,
    "op9_minhash_ngram_join": op9_minhash_ngram_join,
    "op10_boosted_toxicity": op10_boosted_toxicity,
}

def _sql() -> dict[str, str]:
    from paragram.llm import debruijn, ngram_join, rules

    return {"op5_debruijn_substring_dedup": debruijn.SQL, "op8_rule_ledger": rules.SQL, "rule_ablation": rules.ABLATION_SQL, "op9_minhash_ngram_join": ngram_join.SQL}


SQL: dict[str, str] = _sql()
