"""Small files and folders of a shared store, through Spark's own file systems: listings, one-step
commits, and removal of whole folders.  Table data never passes through here."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no such folder."""
    where, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def tree_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """(files, bytes) below a folder."""
    where, fs = _path(spark, path)
    summary = fs.getContentSummary(where)
    return summary.getFileCount(), summary.getLength()


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _path(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make ``path`` with all of ``text`` in one step: written beside it, then renamed.  False, and no
    change, if it exists already."""
    where, fs = _path(spark, path)
    if fs.exists(where):
        return False
    beside, _ = _path(spark, f"{where.getParent().toString()}/.{where.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if fs.rename(beside, where):
        return True
    fs.delete(beside, False)
    return False


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a file, or a folder with all below it."""
    where, fs = _path(spark, path)
    return fs.delete(where, True)
