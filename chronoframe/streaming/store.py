"""The stream's tables: a window log, an online snapshot kept as a base and deltas, and the manifest that
makes both visible in one step (U3, O1, K9).

A micro-batch writes its log rows and the snapshot keys it changed, each to a folder of its own, and
then one small manifest file that names them.  Readers take the newest manifest, so they see
both of a batch or neither.  A batch that dies between its writes leaves folders that no manifest
names; its replay writes them again.  A batch that the manifest already has is not written again.

The manifest holds the last batch id, the base and the deltas since the base: its size is bounded by
``compact_every``, after which a batch folds the deltas into a new base.  There is one writer, as a
streaming query has; a second one that loses the race for a manifest's name gets an error.  The store must rename
a file in one step, as HDFS, ABFS and local disks do; a plain object store needs a commit service for that.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.online import SNAPSHOT_COLS, snapshot_merge, stream_updates
from ..operators.windows import current_windows
from ..sources import files

#: Window rows of a batch from which its days get another log file each, and its delta another file.
LOG_ROWS, DELTA_ROWS = 4_000_000, 100_000


class WindowStore:
    def __init__(self, spark: SparkSession, root: str, compact_every: int = 20):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every

    # --- manifest -----------------------------------------------------------------
    def head(self) -> dict:
        """The newest manifest."""
        found = [n for n in files.names(self.spark, f"{self.root}/manifest") if n.endswith(".json") and n[0] != "."]
        if not found:
            return {"seq": 0, "batch_id": -1, "base": None, "deltas": []}
        return json.loads(files.read_text(self.spark, f"{self.root}/manifest/{found[-1]}"))

    def _commit(self, head: dict) -> None:
        if not files.write_once(self.spark, f"{self.root}/manifest/{head['seq']:012d}.json", json.dumps(head)):
            raise RuntimeError(f"manifest {head['seq']} of {self.root} exists: the table has another writer")

    # --- reading --------------------------------------------------------------------
    def log(self) -> DataFrame | None:
        """The rows of all committed batches; ``dt`` is the day of the window."""
        last = self.head()["batch_id"]
        return None if last < 0 else self.spark.read.parquet(f"{self.root}/log").where(F.col("batch_id") <= last)

    def windows(self, since=None) -> DataFrame | None:
        """K8: the current row of each window; ``since`` reads the day folders from that day on alone."""
        log = self.log()
        if log is not None and since is not None:
            log = log.where(F.col("dt") >= F.lit(str(since)).cast("date"))
        return None if log is None else current_windows(log.drop("dt"))

    def snapshot(self) -> DataFrame | None:
        """The newest entry of every key, from the base and the deltas."""
        return self._entries(self.head())

    def _entries(self, head: dict) -> DataFrame | None:
        parts = [p for p in [head["base"], *head["deltas"]] if p]
        if not parts:
            return None
        rows = self.spark.read.parquet(*[f"{self.root}/{p}" for p in parts]).select(*SNAPSHOT_COLS)
        return rows if len(parts) == 1 else _newest(rows)

    # --- writing ----------------------------------------------------------------------
    def write_batch(self, stats: DataFrame, batch_id: int, ttl_seconds: int) -> bool:
        """Log rows, changed keys and manifest of one batch; False if the batch is committed already."""
        head = self.head()
        if batch_id <= head["batch_id"]:
            return False
        n = stats.count()
        self._write_log(stats, batch_id, n)
        delta = self._write_delta(stats, batch_id, ttl_seconds, n)
        head = head | {"seq": head["seq"] + 1, "batch_id": batch_id, "deltas": [*head["deltas"], delta]}
        self._commit(head)
        if len(head["deltas"]) >= self.compact_every:
            self.compact()
        return True

    def _write_log(self, stats: DataFrame, batch_id: int, n: int) -> None:
        """The rows of a day come together, in as many files as the batch's size asks for: a stateful query runs without
        adaptive execution, so each of its many tasks would write a small file for every day otherwise."""
        part = F.pmod(F.xxhash64("entity_id", "event_type", "window_start"), F.lit(-(-n // LOG_ROWS) or 1))
        (stats.withColumn("dt", F.to_date("window_start")).withColumn("batch_id", F.lit(batch_id).cast("long"))
         .repartition("dt", part)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch_id").parquet(f"{self.root}/log"))

    def _write_delta(self, stats: DataFrame, batch_id: int, ttl_seconds: int, n: int) -> str:
        name = f"delta/batch={batch_id:012d}"
        rows = stream_updates(_zone_free(stats), batch_id, ttl_seconds)
        (snapshot_merge(None, rows).coalesce(-(-n // DELTA_ROWS) or 1)
         .write.mode("overwrite").parquet(f"{self.root}/{name}"))
        return name

    def compact(self) -> None:
        """Fold the deltas into a new base; the visible entries stay the same."""
        head = self.head()
        entries = self._entries(head)
        if entries is None or not head["deltas"]:
            return
        base = f"base/{head['seq'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        entries.write.parquet(f"{self.root}/{base}")
        self._commit(head | {"seq": head["seq"] + 1, "base": base, "deltas": []})


def _newest(rows: DataFrame) -> DataFrame:
    rest = [c for c in SNAPSHOT_COLS if c not in ("entity_id", "feature_name")]
    return rows.groupBy("entity_id", "feature_name").agg(
        F.max_by(F.struct(*rest), F.struct("written_at", "write_seq")).alias("r")).select(
        "entity_id", "feature_name", *[F.col(f"r.{c}").alias(c) for c in rest])


def _zone_free(stats: DataFrame) -> DataFrame:
    return (stats.drop("last_updated").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
            .withColumn("window_end", F.col("window_end").cast("timestamp_ntz")))


class StoreSink:
    """foreachBatch sink into a ``WindowStore`` (U3, U5, K9).  Failures are raised, so Spark runs the
    batch again instead of committing a lost one."""

    def __init__(self, root: str, ttl_seconds: int = 3600, compact_every: int = 20):
        self.root, self.ttl_seconds, self.compact_every = root, ttl_seconds, compact_every

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        stats = batch.persist()
        try:
            if not stats.isEmpty():
                WindowStore(batch.sparkSession, self.root, self.compact_every).write_batch(stats, batch_id, self.ttl_seconds)
        finally:
            stats.unpersist()
