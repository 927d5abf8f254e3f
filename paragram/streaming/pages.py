"""The map-side part of page mining on a stream: new page files in, cleaned source lines with their nearest sentence out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paragram.plans import pages as P


def stream_pages(spark: SparkSession, path: str, schema: str, page: str, text: str, files_a_trigger: int = 8) -> DataFrame:
    """A stream of pages from Parquet files: page_id, page_text."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return rows.selectExpr(f"{page} AS page_id", f"{text} AS page_text")


def mined_stream(pages: DataFrame, surface=None, english=None) -> DataFrame:
    """Greedy mining keeps no state over pages, so it runs on a stream as it is."""
    return P.mined_greedy(pages, surface=surface, english=english)


def start(mined: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Appends what is found to Parquet; files and checkpoint make it exactly once."""
    query = mined.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (query.trigger(availableNow=True) if once else query).start()
