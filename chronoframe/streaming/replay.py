"""Drive the streaming job over events derived from the given tables: JSON
files appended in event-time slices and the real foreachBatch sink.  Used by
the stream-equals-batch checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .job import event_json, run_quarantine, run_stream
from .store import WindowStore


def time_slices(events: DataFrame, slices: int):
    """``slices`` contiguous event-time ranges covering all events."""
    bounds = events.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    step = (hi - lo) / slices
    for i in range(slices):
        cond = F.col("timestamp") >= F.lit(lo + step * i).cast("timestamp_ntz")
        if i < slices - 1:
            cond = cond & (F.col("timestamp") < F.lit(lo + step * (i + 1)).cast("timestamp_ntz"))
        yield events.where(cond)


def drain_batches(spark: SparkSession, batches, closed: bool = False, length: str = "5 minutes", slide: str = "1 minute",
                  watermark: str = "10 minutes", compact_every: int = 3) -> WindowStore:
    """Append one batch of broker-style JSON files at a time and restart the
    stream from its checkpoint with ``availableNow`` after each, so every
    one is a micro-batch (and each restart exercises recovery)."""
    root = scratch_path(spark, "stream")
    src, now = f"{root}/in", {"availableNow": True}
    for part in batches:
        event_json(part).write.mode("append").text(src)
        raw = spark.readStream.format("text").load(src)
        for q in (run_stream(raw, f"{root}/store", f"{root}/ckpt", closed, length, slide, watermark,
                             compact_every=compact_every, trigger=now),
                  run_quarantine(raw, f"{root}/quarantine", f"{root}/quarantine-ckpt", trigger=now)):
            q.awaitTermination()
            if q.exception():
                raise RuntimeError(str(q.exception()))
    return WindowStore(spark, f"{root}/store")


def drain_events_stream(spark: SparkSession, events: DataFrame, slices: int = 4, closed: bool = False) -> WindowStore:
    """The events in time slices, each a micro-batch."""
    return drain_batches(spark, time_slices(events, slices), closed)
