"""Numbers 1, 2, 3... over a whole table in a given order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_SHIFT = 33  # places of a row number in monotonically_increasing_id


def number_rows(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows with ``name``: their place in the order of ``keys``, which tell all rows apart.  Range partitions
    are sorted and numbered each; one count per partition goes through the driver."""
    placed = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _SHIFT)
    before, total = [], 0
    for r in sorted(placed.groupBy(part.alias("p")).count().collect()):
        before.append((r["p"], total))
        total += r["count"]
    offsets = rows.sparkSession.createDataFrame(before, "_p bigint, _before bigint")
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << _SHIFT) - 1) + 1
    return placed.join(offsets, part == F.col("_p")).withColumn(name, number).select(*rows.columns, name)
