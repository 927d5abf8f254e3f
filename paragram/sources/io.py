"""Sources and sinks: CSV, parallel line files, literal tables, text, JSON and Markdown."""

from __future__ import annotations

import contextlib
import logging
import threading
import time
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("paragram")

def read_csv(spark: SparkSession, path: str, columns: list[str], keep_missing: bool = False, **options) -> DataFrame:
    """Columns by name, all strings, quoted cells over several lines; columns the file lacks are empty (null: keep_missing).

    NUL characters vanish.  Such files can't be split between tasks: convert large ones once with to_parquet.
    """
    raw = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8", **options).csv(path)
    names = {c.lstrip("\ufeff"): c for c in raw.columns}
    cell = lambda c: F.replace(F.col(f"`{names[c]}`"), F.lit("\x00"), F.lit("")) if c in names else F.lit(None).cast("string")
    return raw.select(*[(cell(c) if keep_missing else F.coalesce(cell(c), F.lit(""))).alias(c) for c in columns])


def to_parquet(df: DataFrame, path: str, booleans: tuple[str, ...] = ()) -> DataFrame:
    """df as Parquet, text flags as booleans, so that filters on them reach the scan."""
    for b in booleans:
        df = df.withColumn(b, is_true(F.col(b)))
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def is_true(c: Column) -> Column:
    """The text 'true' in any case, or a true boolean."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


#: Where str.splitlines() ends a line besides \n, \r and \r\n, at which the text source ends one.
_RARE_END = "[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and line of a text file, or of a folder's files in order of their names; U+FFFD for broken bytes.

    Lines end where str.splitlines() ends them (one that ends in a rarer separator at the very end of a file has an empty
    one after it).  Files are split between tasks: lines are numbered within their block, and the blocks' counts, a row for
    each block, give the numbers before.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    block = ["file", "start"]
    rows = raw.select(*block, "id", F.posexplode(F.split("value", _RARE_END)).alias("i", "line"))
    size = rows.groupBy(*block).agg(F.count("*").alias("n"))
    before = size.select(*block, F.coalesce(F.sum("n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*block).orderBy("id", "i"))
    return rows.withColumn("n", within).join(F.broadcast(before), block).select((F.col("before") + F.col("n")).alias("line_no"), "line")


def read_parallel(spark: SparkSession, src: str, tgt: str, clean=None, drop_empty: bool = False, max_pairs: int | None = None) -> DataFrame:
    """line_no, src, tgt of two files aligned by line; lines beyond the shorter file vanish.  max_pairs: the first ones that stay."""
    s = read_lines(spark, src).withColumnRenamed("line", "src")
    t = read_lines(spark, tgt).withColumnRenamed("line", "tgt")
    out = s.join(t, "line_no")
    if clean is not None:
        out = out.withColumn("src", clean(F.col("src"))).withColumn("tgt", clean(F.col("tgt")))
    if drop_empty:
        out = out.where("src <> '' AND tgt <> ''")
    return out if max_pairs is None else out.orderBy("line_no").limit(max_pairs)


def read_modes(spark: SparkSession, paths: dict[str, tuple[str, str]], clean=None) -> DataFrame:
    """Several parallel corpora: mode, mode_ord, line_no, row_id (mode:line), src, tgt."""
    out = None
    for i, (mode, (src, tgt)) in enumerate(paths.items()):
        one = read_parallel(spark, src, tgt, clean).select(F.lit(mode).alias("mode"), F.lit(i).alias("mode_ord"), "line_no", F.concat_ws(":", F.lit(mode), "line_no").alias("row_id"), "src", "tgt")
        out = one if out is None else out.unionByName(one)
    return out


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, T._parse_datatype_string(schema))


def _laid_out(df: DataFrame, order: tuple[str, ...], one_file: bool) -> DataFrame:
    """Rows in order over the files (by ranges, each sorted), or in one file."""
    rows = df.orderBy(*order) if order else df
    return rows.coalesce(1) if one_file else rows


def write_lines(df: DataFrame, path: str, column: str, *order: str, one_file: bool = False) -> None:
    """One line a row, in order over the folder's files; newlines inside become spaces."""
    _write_lines(_laid_out(df, order, False), path, column, one_file)


def _write_lines(rows: DataFrame, path: str, column: str, one_file: bool = False) -> None:
    rows.select(F.regexp_replace(F.coalesce(column, F.lit("")), "[\\r\\n]+", " ").alias("value")).write.mode("overwrite").text(path)
    if one_file:
        _merge(rows.sparkSession, path)


def _merge(spark: SparkSession, path: str) -> None:
    """The folder's files as one, in order of their names.  Sorted by many tasks, streamed here in small pieces: no task holds all rows."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    fs = hadoop.fs.Path(path).getFileSystem(conf)
    parts = sorted((s.getPath() for s in fs.listStatus(hadoop.fs.Path(path)) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    whole = hadoop.fs.Path(path, "_whole")
    out = fs.create(whole, True)
    try:
        for part in parts:
            source = fs.open(part)
            try:
                hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            finally:
                source.close()
    finally:
        out.close()
    for part in parts:
        fs.delete(part, False)
    fs.rename(whole, hadoop.fs.Path(path, "part-00000.txt"))


def write_parallel(df: DataFrame, src: str, tgt: str, *order: str, one_file: bool = False) -> None:
    """Both sides in the same order, sorted once."""
    with kept(_laid_out(df.select("src", "tgt", *order), order, False)) as rows:
        _write_lines(rows, src, "src", one_file)
        _write_lines(rows, tgt, "tgt", one_file)


def write_csv(df: DataFrame, path: str, columns: dict[str, str] | list[str], *order: str, one_file: bool = False) -> None:
    """A fixed list of fields (or old name to new), with a header in each file; booleans as true and false."""
    names = columns if isinstance(columns, dict) else {c: c for c in columns}
    rows = _laid_out(df, order, one_file).select(*[F.col(a).alias(b) for a, b in names.items()])
    rows.write.mode("overwrite").options(header=True, escape='"', quoteAll=False).csv(path)


def write_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    _laid_out(df, (), one_file).write.mode("overwrite").json(path)


def write_copies(df: DataFrame, write, *paths: str) -> None:
    """The same rows to several places, computed once; write(df, path) writes them."""
    with kept(df) as rows:
        for path in paths:
            write(rows, path)


@contextlib.contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """df, kept on the executors' disks (and made again where one is lost) while it is written more than once."""
    rows = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield rows
    finally:
        rows.unpersist()


@contextlib.contextmanager
def progress(spark: SparkSession, title: str, every: float = 5.0) -> Iterator[None]:
    """Logs how many tasks of the running stages are done, with the time so far and what is left at that rate."""
    done, began, tracker = threading.Event(), time.time(), spark.sparkContext.statusTracker()

    def watch() -> None:
        while not done.wait(every):
            stages = [i for i in map(tracker.getStageInfo, tracker.getActiveStageIds()) if i is not None]
            log.info("%s", progress_line(title, sum(i.numCompletedTasks for i in stages), sum(i.numTasks for i in stages), time.time() - began))

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        log.info("%s: done after %.1f s", title, time.time() - began)


def progress_line(title: str, part: int, total: int, seconds: float, width: int = 30) -> str:
    """A bar, the share done, and the seconds left at the rate so far."""
    share = part / total if total else 0.0
    left = f"{seconds * (1 - share) / share:.0f} s left" if share else "no estimate yet"
    return f"{title}: [{'#' * int(width * share):<{width}}] {part}/{total} ({share:.0%}), {seconds:.0f} s, {left}"


def report(metrics: DataFrame, samples: DataFrame | None = None, title: str = "Report", most: int = 10) -> str:
    """Markdown of a metrics table (stage, value) and a few sample pairs; reads no more rows than it shows."""
    lines = [f"# {title}", ""] + [f"- {r[0]}: {r[1]}" for r in metrics.limit(200).collect()]
    if samples is not None:
        lines += ["", "## Samples", ""]
        for r in samples.limit(most).collect():
            lines += [f"  - SRC: {str(r['src'])[:220]}", f"  - TGT: {str(r['tgt'])[:220]}"]
    log.info("%s: %d lines", title, len(lines))
    return "\n".join(lines) + "\n"
