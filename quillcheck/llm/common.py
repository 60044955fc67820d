"""Shared folders, staged tables and small Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Folders of tables that were written out, by application, in order.
_WRITTEN: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillcheck-")
    return _OWN[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; no two calls return the same."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: What a batch sent to Python holds at most, where the session leaves Spark's 64 MB as it is.
BATCH_BYTES = "8m"


def lighten(spark: SparkSession) -> None:
    """Send Python smaller batches, so that long texts need little memory in each worker.

    Frames are run after the operator that made them has returned, so the setting stays; one that was chosen is left as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "64m", "64MB", "67108864"):
        spark.conf.set(key, BATCH_BYTES)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    lighten(spark)
    path = shared_path(spark, label)
    df.write.parquet(path)
    written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Folders that ``stage`` has written in this application and ``drop_written`` has not deleted."""
    return _WRITTEN.setdefault(spark.sparkContext.applicationId, [])


def drop_written(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete written tables; no frame that reads one may be used after that."""
    for path in list(paths):
        fs, root = storage(path)
        fs.delete_dir(root)
        written(spark).remove(path)


def drop_orphans(spark: SparkSession, folder: str, index: DataFrame) -> int:
    """Delete the files of a folder that an index (column file) doesn't name, as attempts that failed leave them; how many.

    For when the job that wrote them is over; file names, not records, come to the driver.
    """
    fs, root = storage(folder)
    there = [(f.base_name,) for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File]
    if not there:
        return 0
    found = spark.createDataFrame(there, "file string").join(index.select("file").distinct(), "file", "left_anti").collect()
    for row in found:
        fs.delete_file(f"{root}/{row.file}")
    return len(found)


def partitions(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions to deal ``df`` to: the session's number, and more if by Spark's estimate of its size they would be large."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Without statistics Spark says the largest of numbers, which is no size.
    return max(1, session, min(size // bytes_each, 1_000_000) if size < 1 << 60 else 1)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has that name in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow filesystem and the path in it of a folder's URI."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
