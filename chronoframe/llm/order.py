"""A total order over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

_SHIFT = 33  # places of a row number in monotonically_increasing_id


def by_range(table: DataFrame, *keys) -> DataFrame:
    """``table`` in range partitions of ``keys``, sorted in each.  Rows that are equal in all keys are
    told apart by their place in ``table``, so that no group of them has to fit one partition; the place
    is only the same after a lost executor if ``table`` is read from files, so it must be."""
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    placed = table.withColumn("_place", F.monotonically_increasing_id())
    return (placed.repartitionByRange(*keys, F.col("_place")).sortWithinPartitions(*keys, F.col("_place"))
            .drop("_place"))


def numbered(table: DataFrame, keys: list, name: str, keep: list | None = None) -> DataFrame:
    """The rows (columns ``keep``), written, with ``name``: 1, 2, 3... in the order of ``keys`` over the
    whole table.  What the driver sees is one count per partition."""
    placed = by_range(table, *keys).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = write_table(placed.select(*(keep or table.columns), "_at"), "ordered")
    part = F.shiftright("_at", _SHIFT)
    before, total = [], 0
    for r in sorted(sorted_.groupBy(part.alias("p")).count().collect()):
        before.append((r["p"], total))
        total += r["count"]
    offsets = sorted_.sparkSession.createDataFrame(before, "_p bigint, _before bigint")
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << _SHIFT) - 1) + 1
    return (sorted_.join(offsets, part == F.col("_p")).withColumn(name, number).drop("_at", "_p", "_before"))
