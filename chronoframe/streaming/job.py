"""Structured Streaming job: JSON events -> sliding-window stats -> window
log + online snapshot (S1-S4, F8, K1-K10, U3-U5, U7).

The source is injected (Kafka on a cluster, a file stream in tests); the
transform is ``windows.window_stats`` -- the same one the batch backfill uses
(K11).  Each micro-batch is persisted once and written to a ``store.WindowStore``:
log rows and changed snapshot keys, made visible together by one manifest.
Sink failures are raised, so Spark retries the batch instead of committing a
lost one.  ``progress.ProgressTable`` keeps the progress of every batch (K10).
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.windows import window_stats
from .store import StoreSink

#: Where ``run_stream`` keeps the windows of a batch: on the executors' disks, with bounded memory.  Spark's default holds them
#: all in the heap, where those of a large batch don't fit.  A checkpoint goes on with the store that it was begun with.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


def decode_events(raw: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """bytes/string JSON -> typed events, plus the quarantine of
    rows that did not parse (no entity, or an unparseable timestamp).
    Event time is TIMESTAMP (watermarks need it): one with an offset is that instant, one without is read in
    the session's zone, which ``build_session`` sets to UTC."""
    text = F.col(value_col).cast("string")
    # By a generator, so that a row is parsed once: the filters below would take from_json with them otherwise, once per column.
    parsed = raw.select(text.alias("_raw"), F.inline(F.array(F.from_json(text, schemas.EVENT_JSON))))
    ev = parsed.select("_raw", "entity_id", "event_type", "value",
                       F.try_to_timestamp("timestamp").alias("timestamp"), "metadata")
    good = (F.col("entity_id").isNotNull() & F.col("timestamp").isNotNull() & F.col("event_type").isNotNull())
    events = ev.where(good).drop("_raw").withColumn("processing_time", F.current_timestamp())
    quarantine = ev.where(~good).select(
        "_raw", F.when(F.col("entity_id").isNull(), "unparsed_or_no_entity")
        .when(F.col("timestamp").isNull(), "bad_timestamp").otherwise("no_event_type").alias("reason"))
    return events, quarantine


def event_json(events: DataFrame) -> DataFrame:
    """Render domain events as the JSON ``value`` a broker would carry."""
    return events.select(F.to_json(F.struct(
        "entity_id", "event_type", "value",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "metadata")).alias("value"))


def run_stream(raw_stream: DataFrame, root: str, checkpoint: str, closed: bool = True, length: str = "5 minutes",
              slide: str = "1 minute", watermark: str = "10 minutes", ttl_seconds: int = 3600, compact_every: int = 20,
              trigger: dict | None = None, query_name: str | None = None):
    """Start the job (K1-K6, U3, U5, O1): window stats into the ``WindowStore`` at ``root``, log and snapshot
    visible together.  With ``closed`` (append mode) a window leaves once, when the watermark has passed its end, so
    the snapshot holds values of closed windows alone; without it (update mode) every change of a window does.
    ``trigger`` defaults to every 10 seconds; tests pass ``{"availableNow": True}``.  Returns the
    StreamingQuery.  Rows that do not decode are ``run_quarantine``'s."""
    events, _ = decode_events(raw_stream)
    stats = window_stats(events, length, slide, watermark=watermark)
    w = (stats.writeStream.foreachBatch(StoreSink(root, ttl_seconds, compact_every))
         .outputMode("append" if closed else "update").option("checkpointLocation", checkpoint))
    if query_name:
        w = w.queryName(query_name)
    with _settings(raw_stream.sparkSession, STATE_STORE):  # a query keeps those that it was started with
        return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


@contextlib.contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    """The settings that the session doesn't name itself, for a while."""
    mine = {k: v for k, v in settings.items() if k not in spark.conf.getAll}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in mine:
            spark.conf.unset(k)


def run_quarantine(raw_stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append every row that did not decode, with its reason, to
    ``path``.  A query of its own beside ``run_stream``, with its own
    checkpoint, so that each bad row is written exactly once."""
    _, bad = decode_events(raw_stream)
    return (bad.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start())


def kafka_options(servers: str, topic: str, starting_offsets: str = "latest",
                  max_offsets_per_trigger: int | None = None, fail_on_data_loss: bool = True) -> dict[str, str]:
    """Reader options of the broker source."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting_offsets,
               "failOnDataLoss": str(fail_on_data_loss).lower()}
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_kafka(spark: SparkSession, **source) -> DataFrame:
    """The raw stream of a topic (``kafka_options``); needs the connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(**source)).load()
