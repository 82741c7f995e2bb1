"""The progress of every micro-batch, kept as a table.

A query object holds its last hundred progress reports only.  ``ProgressTable`` listens to the session's
streaming queries and writes each batch's report as one small JSON file named by query, run and batch, so
a report that arrives twice is one row; ``compact`` folds the files into Parquet.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import files

PROGRESS = ("query_id string, run_id string, query_name string, batch_id bigint, started_at timestamp, input_rows bigint, "
            "input_rps double, processed_rps double, duration_ms bigint, state_rows bigint, "
            "dropped_by_watermark bigint, watermark timestamp")


class ProgressTable(StreamingQueryListener):
    """Register with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"query_id": str(p.id), "run_id": str(p.runId), "query_name": p.name, "batch_id": p.batchId,
               "started_at": p.timestamp, "input_rows": p.numInputRows, "input_rps": _number(p.inputRowsPerSecond),
               "processed_rps": _number(p.processedRowsPerSecond), "duration_ms": dict(p.durationMs).get("triggerExecution"),
               "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
               "dropped_by_watermark": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
               "watermark": dict(p.eventTime).get("watermark")}
        files.write_once(self.spark, f"{self.path}/new/{p.id}-{p.runId}-{p.batchId:012d}.json", json.dumps(row) + "\n")

    def table(self) -> DataFrame:
        """One row per batch and run."""
        parts = []
        if files.exists(self.spark, f"{self.path}/new"):
            parts.append(self.spark.read.schema(PROGRESS).json(f"{self.path}/new"))
        if files.exists(self.spark, f"{self.path}/old"):
            parts.append(self.spark.read.schema(PROGRESS).parquet(f"{self.path}/old"))
        if not parts:
            return self.spark.createDataFrame([], PROGRESS)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.dropDuplicates(["query_id", "run_id", "batch_id"])

    def compact(self) -> None:
        """Move the reports that are there now into Parquet.  A stop in between leaves reports in both
        places, which ``table`` counts once."""
        found = [n for n in files.names(self.spark, f"{self.path}/new") if n.endswith(".json") and n[0] != "."]
        if not found:
            return
        paths = [f"{self.path}/new/{n}" for n in found]
        self.spark.read.schema(PROGRESS).json(paths).coalesce(1).write.mode("append").parquet(f"{self.path}/old")
        for p in paths:
            files.remove(self.spark, p)


def _number(x) -> float | None:
    return None if x is None or x != x or x in (float("inf"), float("-inf")) else float(x)


def batch_histogram(progress: DataFrame, bounds_s=(1, 5, 10, 30, 60, 120, 300)) -> DataFrame:
    """Cumulative counts of batch durations per query (fixed bounds in seconds, and all)."""
    seconds = F.col("duration_ms") / 1000
    return progress.groupBy("query_name").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("input_rows").alias("input_rows"), F.sum("dropped_by_watermark").alias("dropped"),
        *[F.count_if(seconds <= b).alias(f"le_{b}") for b in bounds_s])
