"""Shared helpers of the training-data operators."""

from __future__ import annotations

import importlib.util
import itertools
import os
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path, table_path

#: UTF-8 bytes of text that a Python worker handles in one numpy step.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files, so
    a lost executor costs a task and not the whole lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(sc: SparkContext) -> None:
    """Send this package's code to the executors, once per application."""
    if sc.applicationId in _shipped:
        return
    name = __name__.partition(".")[0]
    top = os.path.dirname(importlib.util.find_spec(name).origin)
    folder = os.path.join(SparkFiles.getRootDirectory(), "code")  # Spark's own folder of the driver
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for where, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(where, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, work: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package's code on the executors."""
    ship(df.sparkSession.sparkContext)
    return df.mapInArrow(work, schema)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str,
             limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; every row stays whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // limit)) + 1
        for a, b in itertools.pairwise([0, *cuts.tolist(), n]):
            if b > a:
                yield batch.slice(a, b - a)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches sorted by ``keys``.  Many small groups come
    together; the caller bounds the size of a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = np.ones(table.num_rows, bool)
        for k in keys:
            col = table.column(k).to_numpy()
            last &= col == col[-1]
        start = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if start:
            yield table.slice(0, start)
            held = table.slice(start).combine_chunks().to_batches()
        elif len(held) > 64:
            held = table.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal keys in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix) on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def series(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values of a seed, the same on every machine."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32))) * step)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root
