"""Labelled documents for training: all of them by their features, and bounded samples of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragram.llm import storage, workers
from paragram.llm.textbytes import buffers, mix64, slices, window_hashes, window_valid, words_of

#: Most labelled rows that the toxicity classifier learns from.
SAMPLE_ROWS = 20_000


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int = SAMPLE_ROWS) -> DataFrame:
    """text, label (int), part (0 to 99, by a hash of the id), h of at most `most` labelled documents outside the held-out fold.

    The ids with the lowest hashes are taken, so the sample depends on nothing but the ids.  Rows without a label are left
    out; of an id's several labels the least counts, and of its several texts the one of least hash, so an id is one row.
    The ids, `most` at most, are the one thing broadcast.
    """
    open_ = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != held_out))
    ids = open_.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = ids.select(F.col("doc_id").alias("_id"), "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "_id").limit(most)
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    joined = texts.groupBy("_id", "label", "h").agg(F.min(F.struct(F.xxhash64("text").alias("x"), "text")).alias("t")).select("t.text", "label", "h")
    return storage.written(joined.select("text", "label", F.pmod("h", F.lit(100)).cast("int").alias("part"), "h"), "labelled")


def labelled_once(table: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """label (int), h, x of every labelled document of a table (doc_id, t, x) outside the held-out fold.

    Rows without a label are left out; of an id's several labels the least counts, and of its several rows the one of least t,
    so an id is one row.
    """
    open_ = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != held_out))
    ids = open_.groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).cast("int").alias("label"))
    once = table.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct("t", "x")).alias("own"))
    return once.join(ids, "_id").select("label", F.xxhash64("_id").alias("h"), F.col("own.x").alias("x"))


#: Seeds of the minima of a sketch.
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _sketches(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of the least values, under each seed, of the three-word windows of each row (shorter rows: of its words; none: 0)."""
    w = words_of(raw, offsets)
    hashes, rows, row = w.hashes(), w.rows, w.row_of()
    short = w.counts()[row] < 3
    at = np.flatnonzero(window_valid(w.first, 3))
    windows = window_hashes(hashes, 3)[at]
    out = np.zeros(rows, dtype=np.uint64)
    for seed in _SEEDS:
        least = np.full(rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(least, row[short], mix64(hashes[short] ^ seed))
        np.minimum.at(least, row[at], mix64(windows ^ seed))
        out = mix64(out + least)
    out[w.counts() == 0] = 0
    return out.view(np.int64)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row of each group of copies and near copies with the same label that share a sketch, so that copies count as one piece of evidence.

    A sketch holds several minima, so texts that only share a passage stay apart.  For bounded samples.  The row with the
    lowest h stays.
    """

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for a, b in slices(offsets):
                s = _sketches(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns] + [pa.array(s)], [*batch.schema.names, "sketch"])

    out = rows.select("text", "label", "part", "h").mapInArrow(workers.task(run), "text string, label int, part int, h long, sketch long")
    first = F.row_number().over(Window.partitionBy("sketch", "label").orderBy("h"))
    return storage.written(out.withColumn("first", first).where("first = 1").drop("first", "sketch"), "distinct")
