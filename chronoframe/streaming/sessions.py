"""N6 on a stream: sessions per entity, merged in the state store as events arrive.

Event-time session windows in append mode: a session leaves once, when the watermark has passed its last event
by the gap.  Open sessions are state, so an entity costs one row while it is active.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import seconds_between
from ..operators.asof import interval_seconds
from ..session import scratch_path
from .job import decode_events, event_json
from .replay import time_slices

#: Entity of the events that only move the watermark on.  Readers leave its sessions out; a filter in the stream itself
#: would be pushed below the watermark, which would then not see them.
CLOCK = "__clock__"


def session_stats(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """(entity_id, session_start, session_end, n_events) of a stream of events."""
    return (events.withWatermark("timestamp", watermark)
            .groupBy("entity_id", F.session_window("timestamp", f"{interval_seconds(gap)} seconds").alias("sw"))
            .agg(F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"), F.count(F.lit(1)).alias("n_events"))
            .drop("sw"))


def run_sessions(raw_stream: DataFrame, path: str, checkpoint: str, gap: str = "30 minutes", watermark: str = "10 minutes",
                 trigger: dict | None = None):
    """Start the session job; closed sessions are appended to the Parquet table ``path``, each exactly once."""
    events, _ = decode_events(raw_stream)
    return (session_stats(events, gap, watermark).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start())


def drain_sessions(spark: SparkSession, events: DataFrame, slices: int = 4, gap: str = "30 minutes",
                   watermark: str = "10 minutes") -> DataFrame:
    """All sessions of the events, fed slice by slice with a restart after each; an event of the clock, past the last one by
    gap and watermark, closes what is open at the end."""
    root = scratch_path(spark, "sessions")
    after = interval_seconds(gap) + interval_seconds(watermark) + 60
    clock = (events.agg(F.max("timestamp").alias("last")).where("last is not null")
             .select(F.lit(CLOCK).alias("entity_id"), F.lit("clock").alias("event_type"), F.lit(None).cast("double").alias("value"),
                     F.timestamp_add("SECOND", F.lit(after), F.col("last")).alias("timestamp"), F.lit(None).cast("string").alias("metadata")))
    for part in [*time_slices(events, slices), clock]:
        event_json(part).write.mode("append").text(f"{root}/in")
        q = run_sessions(spark.readStream.format("text").load(f"{root}/in"), f"{root}/out", f"{root}/ckpt", gap, watermark,
                         trigger={"availableNow": True})
        q.awaitTermination()
        if q.exception():
            raise RuntimeError(str(q.exception()))
    s = spark.read.schema("entity_id string, session_start timestamp, session_end timestamp, n_events bigint").parquet(f"{root}/out").where(F.col("entity_id") != CLOCK)
    s = s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
    return s.withColumn("session_duration_seconds", F.floor(seconds_between("session_end", "session_start")).cast("long"))
