"""Adapters from the driver's tables to frames of the operators' shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables whose rows are texts, on which nearly all queries spend their time.
TEXTS = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer files than the session has cores are dealt to all cores, as one file may be one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and len(df._jdf.inputFiles()) < cores else df


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn (src) and the assistant's next one (tgt): conv_id, turn, src, tgt."""
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return u.join(a, ["conv_id", "turn"])


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges as three external corpora by conv_id % 3: mode, mode_ord, line_no, row_id, src, tgt."""
    e = exchanges(spark, sf_dir).withColumn("mode_ord", (F.col("conv_id") % 3).cast("int")).withColumn("line_no", F.col("conv_id") * 1000 + F.col("turn"))
    mode = F.when(F.col("mode_ord") == 0, "train").when(F.col("mode_ord") == 1, "valid").otherwise("test")
    return e.select(mode.alias("mode"), "mode_ord", "line_no", F.concat_ws(":", mode, "line_no").alias("row_id"), "src", "tgt")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("page_text"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as reference texts: ref, ref_text, aliases (their first word)."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("ref"), F.col("text").alias("ref_text"), F.substring_index("text", " ", 2).alias("aliases"))
