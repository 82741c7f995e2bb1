"""Sliding-window statistics over events, batch or stream (K1-K3, K7, K8,
K11, A1-A5, R1, R4, U7).

``window_stats`` is the same transform for ``spark.read`` and
``spark.readStream`` input: avg, sample stddev, max, min per (entity, event
type, window).  The aggregates are fixed-width, so Spark uses a hash
aggregate with map-side partial aggregation; a sliding window expands each
row ``length / slide`` times before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import latest_versions
from .writes import upsert_days


def window_stats(events: DataFrame, length: str = "5 minutes", slide: str = "1 minute",
                 watermark: str | None = None, time_col: str = "timestamp",
                 suffix: str = "5min") -> DataFrame:
    """K2/K3/A1-A5/R1.  ``watermark`` (K1) only for streams.  Rows with a NULL
    event time never reach a window (F8)."""
    df = events
    if watermark:
        df = df.withWatermark(time_col, watermark)
    aggs = [
        F.avg("value").alias(f"avg_{suffix}"),
        F.stddev_samp("value").alias(f"stddev_{suffix}"),
        F.max("value").alias(f"max_{suffix}"),
        F.min("value").alias(f"min_{suffix}"),
        F.count("value").alias("n_events"),
    ]
    if "processing_time" in df.columns:
        aggs.append(F.max("processing_time").alias("last_updated"))
    g = df.groupBy("entity_id", "event_type", F.window(time_col, length, slide).alias("window")).agg(*aggs)
    return g.select("entity_id", "event_type",
                    F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"),
                    *[c for c in g.columns if c not in ("entity_id", "event_type", "window")])


# Stream feature name -> registry name (the stream's avg of purchases is
# registered under a different name).
DEFAULT_NAME_MAP = {"avg_5min_purchase": "avg_5min_purchase_value"}


def stats_to_features(stats: DataFrame, name_map: dict | None = None,
                      stats_kept=("avg", "max"), suffix: str = "5min") -> DataFrame:
    """Wide window stats -> long ``(entity_id, feature_name,
    value_num, event_ts = window_end)``; names ``{stat}_{suffix}_{event_type}``
    mapped through ``name_map``.  NULL values are skipped, 0.0 is kept."""
    cols = [f"{s}_{suffix}" for s in stats_kept]
    long = stats.unpivot(["entity_id", "event_type", "window_start", "window_end"], cols, "stat", "value_num")
    return long.where(F.col("value_num").isNotNull()).select(
        "entity_id", _feature_name(name_map).alias("feature_name"), "value_num",
        F.col("window_end").alias("event_ts"), "window_start")


def newest_features(stats: DataFrame, name_map: dict | None = None,
                    stats_kept=("avg", "max"), suffix: str = "5min") -> DataFrame:
    """``stats_to_features`` of the newest window with a value, per entity, event type and statistic: ``(entity_id,
    feature_name, value_num, event_ts)``.  Values and times are fixed-width, so the windows pass a hash aggregate once
    for all statistics, before any name is made."""
    cols = [f"{s}_{suffix}" for s in stats_kept]
    end = {c: F.when(F.col(c).isNotNull(), F.col("window_end")) for c in cols}
    newest = stats.groupBy("entity_id", "event_type").agg(
        *[a for c in cols for a in (F.max_by(c, end[c]).alias(f"v_{c}"), F.max(end[c]).alias(f"t_{c}"))])
    long = newest.select("entity_id", "event_type", F.inline(F.array(*[
        F.struct(F.lit(c).alias("stat"), F.col(f"v_{c}").alias("value_num"), F.col(f"t_{c}").alias("event_ts")) for c in cols])))
    return long.where(F.col("event_ts").isNotNull()).select(
        "entity_id", _feature_name(name_map).alias("feature_name"), "value_num", "event_ts")


def _feature_name(name_map: dict | None) -> Column:
    name_map = DEFAULT_NAME_MAP if name_map is None else name_map
    name = F.concat(F.col("stat"), F.lit("_"), F.col("event_type"))
    if not name_map:
        return name
    mapping = F.create_map(*[x for k, v in name_map.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(mapping, name), name)


def merge_into_history(features: DataFrame, registry: DataFrame, history: DataFrame,
                       batch_seq: int) -> tuple[DataFrame, DataFrame]:
    """Window features (``stats_to_features``) into the history: names are
    resolved to the id of their latest definition and upserted on (feature,
    entity, time).  Returns the touched days' rows for ``write_history``, and
    the names without a definition with the number of their rows."""
    ids = latest_versions(registry).select(F.col("name").alias("feature_name"), "feature_id")
    rows = features.join(ids, "feature_name").select(
        "feature_id", "entity_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"),
        F.col("value_num").cast("string").alias("value_json"), "value_num",
        F.lit("{}").alias("metadata"), F.lit(batch_seq).cast("long").alias("write_seq"))
    unresolved = features.join(ids, "feature_name", "left_anti").groupBy("feature_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return upsert_days(history, rows, ["feature_id", "entity_id", "event_ts"]), unresolved


def current_windows(log: DataFrame, keys=("entity_id", "event_type", "window_start"),
                    seq: str = "batch_id") -> DataFrame:
    """K8: collapse update-mode re-emissions; the row of the latest batch per
    window wins (partial ``max_by`` per column: of fixed-width columns a hash aggregate, while one of a struct sorts
    the whole log).  A batch has one row per window."""
    keys = list(keys)
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(*[F.max_by(c, F.col(seq)).alias(c) for c in rest])
