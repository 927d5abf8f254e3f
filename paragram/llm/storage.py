"""Shared scratch space: the folder that spark.checkpoint.dir names, reachable from every executor."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Hashable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from paragram.llm import workers


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests), a folder of this machine is set once."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="paragram-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = "file://" + own
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)


#: Scratch folders of this process that were not removed yet, by session.
_FOLDERS: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; see ``clear``."""
    folder = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _FOLDERS[folder] = spark
    return folder


def clear(*folders: str) -> None:
    """Removes scratch folders; without names all that are left, also those that results still to be read depend on."""
    for folder in folders or tuple(_FOLDERS):
        spark = _FOLDERS.pop(folder)
        with contextlib.suppress(Exception):  # the session may have ended, and somebody else may have removed it
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside are removed when these end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of executors."""
    folder = scratch(df.sparkSession, name)
    with _freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def written_by(df: DataFrame, function, schema: str | StructType, name: str, needs: Hashable = None) -> DataFrame:
    """df.mapInArrow(function, schema) as a table in the shared folder, written by the Python workers themselves.

    What function yields goes from its worker to a file of its partition, without the way back through the JVM.  A task
    writes under a hidden name and renames, so a repeated task replaces its file whole.  Where pyarrow can't reach the
    folder's file system, Spark writes the table.  needs: the tool of the function, see ``workers.task``.
    """
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    if not reachable(shared_root(df.sparkSession)):
        return written(df.mapInArrow(workers.task(function, needs), kind), name)
    folder, arrow = scratch(df.sparkSession, name), to_arrow_schema(kind)

    def run(batches):
        fs, base = filesystem(folder)
        part = TaskContext.get().partitionId()
        own = f"{base}/_{part:06d}-{uuid.uuid4().hex}"
        writer, held, size = None, [], 0

        def flush():
            nonlocal held, size
            writer.write_table(pa.Table.from_batches(held, arrow))
            held, size = [], 0

        for batch in function(batches):
            if batch.num_rows == 0:
                continue
            if writer is None:
                fs.create_dir(base, recursive=True)
                writer = pq.ParquetWriter(own, arrow, filesystem=fs, compression="zstd")
            held.append(pa.RecordBatch.from_arrays(batch.columns, schema=arrow))
            size += batch.nbytes
            if size > 8 << 20:
                flush()
        if writer is not None:
            if held:
                flush()
            writer.close()
            fs.move(own, f"{base}/part-{part:06d}.zstd.parquet")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64())})

    spark = df.sparkSession
    with _freed(spark):
        df.mapInArrow(workers.task(run, needs), "part long").write.format("noop").mode("overwrite").save()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(folder)


#: Hadoop's names of file systems, and pyarrow's.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}


def reachable(uri: str) -> bool:
    """Whether ``filesystem`` knows the URI's scheme."""
    scheme = uri.partition(":")[0]
    return scheme in ("file", "dbfs") or scheme in _SCHEMES


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, usable on executors (file, dbfs by its mount, s3, s3a, s3n, gs, abfs, abfss, hdfs)."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme == "dbfs":
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def partitions(df: DataFrame) -> int:
    """The cluster's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release(*tables: DataFrame) -> None:
    """Deletes tables made here that are no longer read."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            own = [f for f in _FOLDERS if f.rstrip("/").rpartition("/")[2] == file.rstrip("/").split("/")[-2]]
            clear(*own[:1]) if own else None
